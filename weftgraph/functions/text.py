"""Column functions on text: cleaning steps and tokens. All are built-in expressions unless said."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftgraph.functions.arrays import bind, first_where, running_sum

# Ligatures and what stands for them, and characters that vanish.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\ufeff"
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Patterns and words of what cleaning takes away.
PAGE_OF = r"(?mdi)^.*\bPage\s*\d+\s+of\s+.{3,100}$"
PAGE_NUMBER = r"(?mdi)^\s*(?:Page\s*\d+(?:\s+of\s+.{0,80})?|-\s*\d+\s*-|\d+)\s*$"
FOOTNOTE = r"(?md)^\s*[*†‡§¹²³⁴⁵⁶⁷⁸⁹⁰]\s+\S.{0,200}$"
TRAILING = r"(?mdi)^#{1,4}\s+(?:References|Bibliography|Acknowledgments?|Acknowledgements?|Appendix\b.*|Supplementary\b.*)"
SPECIAL_SECTIONS = (
    "abstract", "introduction", "conclusion", "conclusions", "references", "bibliography", "acknowledgments", "acknowledgements", "appendix", "supplementary",
    "related work", "background", "discussion", "limitations", "future work", "methodology", "experiments", "results", "evaluation",
)
INSTITUTION = r"(?i)University|Institute|School|Lab|Department|Corp|Inc\."
IMAGE = r"!\[([^\]]*)\]\((data:image/[^;]+;base64,[A-Za-z0-9+/=]+)\)"
IMAGE_PLACEHOLDER = r"(?i)<!--\s*image\s*-->"
FIGURE = r"(?i)Figure\s+(\d+[a-z]?)\s*[:.]?\s*([^>📷\n]{10,150})"
REPLY_TITLE = r"(?mdi)^(?:#+\s*)?(?:(?:Figure|Image)\s+)?(?:Description|Summary|Overview|Caption)\s*[:\-]?\s*\n?"


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def repair_unicode(text: Column) -> Column:
    for k, v in LIGATURES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    text = F.translate(F.translate(text, INVISIBLE, ""), "\u00a0", " ")
    return F.regexp_replace(text, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """The full HTML5 entity table has no built-in counterpart: Arrow batches."""
    return text.map(html.unescape, na_action="ignore")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def strip_page_of(text: Column) -> Column:
    """Lines that hold 'Page 3 of' and 3 to 100 more characters."""
    return F.regexp_replace(text, PAGE_OF, "")


def strip_page_numbers(text: Column) -> Column:
    """Lines that are 'Page 3', 'Page 3 of 9', '- 3 -' or a number."""
    return F.regexp_replace(text, PAGE_NUMBER, "")


def strip_page_lines(text: Column) -> Column:
    return strip_page_numbers(strip_page_of(text))


def strip_footnotes(text: Column) -> Column:
    """Lines that begin with a footnote's mark and hold at most 200 characters behind the first of their text."""
    return F.regexp_replace(text, FOOTNOTE, "")


def strip_technical_links(text: Column) -> Column:
    """mailto links keep their display text unless that is an address; bare and numbered URL lines go."""
    text = F.regexp_replace(text, r"\[\s*[^\s\]]+@[^\s\]]+\.[^\s\]]+\s*\]\(mailto:[^)]+\)", "")
    text = F.regexp_replace(text, r"\[\s*([^\]]*?)\s*\]\(mailto:[^)]+\)", "$1")
    text = F.regexp_replace(text, r"(?md)^\s*https?://\S+\s*$", "")
    return F.regexp_replace(text, r"(?md)^\s*\[\d+\s+https?://\S*\]\(https?://[^)]*\)\s*$", "")


def remove_repeated_lines(text: Column, least: int = 3) -> Column:
    """Lines of 6 to 79 characters, no headings, `least` times or more in a text, go with all copies.

    Lines are sorted, a run of equal ones is seen from its neighbours, and what stays is sorted back: no row leaves its place.
    """
    items = F.array_sort(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(strip(x).alias("bare"), i.alias("i"), x.alias("line"))))

    def stays(s: Column) -> Column:
        same = lambda k, other: F.coalesce(F.get(s, k)["bare"] == F.get(s, other)["bare"], F.lit(False))
        in_run = lambda k: F.exists(F.sequence(F.lit(0), F.lit(least - 1)), lambda j: same(k - j, k - j + (least - 1)) & same(k, k - j))
        counts = lambda x: F.length(x["bare"]).between(6, 79) & ~F.startswith(x["bare"], F.lit("#"))
        kept = F.filter(s, lambda x, k: ~(counts(x) & in_run(k)))
        return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line")))), lambda x: x["line"])

    return F.array_join(bind(items, stays), "\n")


def fix_heading_levels(text: Column) -> Column:
    """Lines that begin with exactly '##': numbered by depth, special sections H2, the first other H1, the rest H2."""
    two = lambda x: x.rlike(r"(?d)^##\s+.*")
    title = lambda x: strip(F.regexp_replace(x, r"^##\s+", ""))
    number = lambda x: F.regexp_extract(title(x), r"^(\d+(?:\.\d+)*)\s+.", 1)
    special = lambda x: F.lower(title(x)).rlike(f"^(?:{'|'.join(SPECIAL_SECTIONS)})")
    plain = lambda x: two(x) & (number(x) == "") & ~special(x)

    def fixed(lines: Column) -> Column:
        def line(first: Column) -> Column:
            depth = lambda x, i: F.when(number(x) != "", F.least(F.lit(4), F.size(F.split(number(x), r"\.")) + 1)).when(plain(x) & (i == first), 1).otherwise(2)
            return F.transform(lines, lambda x, i: F.when(two(x), F.concat(F.repeat(F.lit("#"), depth(x, i)), F.lit(" "), title(x))).otherwise(x))

        return bind(first_where(lines, plain), line)

    return F.array_join(bind(F.split(text, "\n", -1), fixed), "\n")


def remove_affiliations(text: Column) -> Column:
    """Between the first H1 and a heading Abstract, Introduction or with a number: lines of authors and institutions go."""
    h1 = lambda x: F.startswith(F.ltrim(x), F.lit("# "))
    ends = lambda x: strip(x).rlike(r"(?i)^#{1,4}\s+(?:Abstract|Introduction|\d+\s+)")

    def author(x: Column) -> Column:
        bare = strip(x)
        place = (F.length(bare) < 200) & bare.rlike(r"\d\s+[\p{L}\p{N}_]") & bare.rlike(INSTITUTION)
        return place | bare.rlike(r"\S+@\S+\.\S+") | (bare.rlike("[†‡§*]") & (F.length(bare) < 150))

    def kept(lines: Column) -> Column:
        def within(top: Column) -> Column:
            end = F.array_min(F.transform(lines, lambda x, i: F.when((i > top) & ends(x), i)))
            return bind(F.coalesce(end, F.size(lines)), lambda e: F.filter(lines, lambda x, i: ~((i > top) & (i < e) & author(x))))

        return bind(first_where(lines, h1), lambda top: F.when(top.isNull(), lines).otherwise(within(top)))

    return F.array_join(bind(F.split(text, "\n", -1), kept), "\n")


def strip_trailing_sections(text: Column) -> Column:
    first = F.get(F.split(text, TRAILING, 2), F.lit(0))
    return F.when(text.rlike(TRAILING), F.concat(F.regexp_replace(first, r"[\s\p{Z}]+\z", ""), F.lit("\n"))).otherwise(text)


def tidy_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?md)[^\S\n]+$", ""))


def ensure_title(text: Column, stem: Column) -> Column:
    title = F.coalesce(F.nullif(F.replace(stem, F.lit("_"), F.lit(" ")), F.lit("")), F.lit("Document"))
    return F.when(text.rlike(r"(?m)^\s*#"), text).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), text))


def normalize_markdown(text: Column, stem: Column) -> Column:
    """Line ends, blank lines and a title only."""
    return ensure_title(tidy_whitespace(normalize_newlines(text)), stem)


def clean_markdown(text: Column, stem: Column, repair: bool = True, links: bool = True, references: bool = True) -> Column:
    """All steps in their order; each works within a row. The flags leave out repair, links or the cut at references."""
    text = html_unescape(normalize_newlines(text))
    steps = [repair_unicode] if repair else []
    steps += [fix_heading_levels, strip_page_of, strip_page_numbers, strip_footnotes]
    steps += [strip_technical_links] if links else []
    steps += [remove_repeated_lines, remove_affiliations]
    steps += [strip_trailing_sections] if references else []
    for step in [*steps, tidy_whitespace]:
        text = bind(text, step)
    return bind(text, lambda t: ensure_title(t, stem))


# ---- images ----


def is_decorative(data_uri: Column, least_bytes: int = 2048) -> Column:
    """Whether a data URI's image has fewer bytes than least_bytes, by the length of its base64."""
    size = F.floor(F.length(F.regexp_extract(data_uri, "base64,([A-Za-z0-9+/=]+)", 1)) * 3 / 4)
    return data_uri.rlike("base64,[A-Za-z0-9+/=]") & (size < least_bytes)


def images(text: Column, context: int = 300) -> Column:
    """Of a text without placeholders: ord, alt, uri, decorative, label, caption of every embedded image, in order.

    caption is what stands behind 'Figure n' within the characters before an image, else these characters themselves.
    """
    bare = F.regexp_replace(text, IMAGE_PLACEHOLDER, "")

    def found(b: Column) -> Column:
        def one(uri: Column, i: Column) -> Column:
            before = F.substring(F.get(b["rest"], i), -context, context)
            figure = F.regexp_extract(before, FIGURE, 1)
            alt = strip(F.get(b["alt"], i))
            named = F.when((alt != "") & ~F.lower(alt).isin("image", "figure"), alt)
            label = F.when(figure != "", F.concat(F.lit("Figure "), figure)).otherwise(F.coalesce(named, F.concat(F.lit("Figure "), (i + 1).cast("string"))))
            caption = F.when(figure != "", strip(F.regexp_extract(before, FIGURE, 2))).otherwise(before)
            return F.struct(i.alias("ord"), alt.alias("alt"), uri.alias("uri"), is_decorative(uri).alias("decorative"), label.alias("label"), caption.alias("caption"))

        return F.transform(b["uri"], one)

    parts = F.struct(F.regexp_extract_all(bare, F.lit(IMAGE), F.lit(1)).alias("alt"), F.regexp_extract_all(bare, F.lit(IMAGE), F.lit(2)).alias("uri"), F.split(bare, IMAGE, -1).alias("rest"))
    return bind(parts, found)


def replace_images(text: Column, described: Column, most: int = 50) -> Column:
    """text with every embedded image replaced by its label and description; decorative ones and placeholders vanish.

    described: an array of descriptions by the image's position. The first `most` images that are not decorative get theirs.
    """
    bare = F.regexp_replace(text, IMAGE_PLACEHOLDER, "")

    def build(b: Column) -> Column:
        shown = running_sum(F.transform(b["img"], lambda x: F.when(x["decorative"], 0).otherwise(1).cast("bigint")))

        def piece(x: Column, i: Column, before: Column) -> Column:
            full = F.concat(F.lit("> 📷 [Figure "), (i + 1).cast("string"), F.lit(" — limite atteinte]"))
            said = F.concat(F.lit("> 📷 **"), x["label"], F.lit("** : "), F.coalesce(F.get(described, i), F.lit("")))
            return F.when(x["decorative"], "").when(before >= most, full).otherwise(said)

        def joined(s: Column) -> Column:
            return F.array_join(F.transform(b["rest"], lambda r, i: F.concat(r, F.when(i < F.size(b["img"]), piece(F.get(b["img"], i), i, F.get(s, i))).otherwise(""))), "")

        return bind(shown, joined)

    return bind(F.struct(F.split(bare, IMAGE, -1).alias("rest"), images(text).alias("img")), build)


def clean_reply(reply: Column, sentences: int = 3) -> Column:
    """A describing model's reply without titles and a leading heading, its first sentences."""
    text = strip(F.regexp_replace(strip(reply), REPLY_TITLE, ""))
    text = strip(F.regexp_replace(text, r"\A\s*#{1,6}\s+[^\n]*\n?", ""))
    return strip(F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, sentences), " "))


def tokens(text: Column) -> Column:
    """White-space tokens, Unicode white space included."""
    return F.filter(F.split(text, r"[\s\p{Z}]+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def normalize_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " "))


def appears_verbatim(needle: Column, hay: Column) -> Column:
    """Containment of normalised text, then with hyphens as spaces."""
    a, b = normalize_ws(needle), normalize_ws(hay)
    bare = lambda x: normalize_ws(F.replace(x, F.lit("-"), F.lit(" ")))
    return F.contains(b, a) | F.contains(bare(b), bare(a))


def morph_normalize(phrase: Column) -> Column:
    """Lower, no possessive at the end, then plural, -ing and -ed endings, each on what the last left."""
    n = F.length
    cut = lambda p, k: F.substr(p, F.lit(1), n(p) - k)
    steps = [
        lambda p: F.regexp_replace(p, r"'s\z", ""),
        lambda p: F.when(p.endswith("ies") & (n(p) > 4), F.concat(cut(p, 3), F.lit("y")))
        .when(p.endswith("es") & (n(p) > 4), cut(p, 2))
        .when(p.endswith("s") & ~p.endswith("ss") & (n(p) > 4), cut(p, 1))
        .otherwise(p),
        lambda p: F.when(p.endswith("ing") & (n(p) > 5), cut(p, 3)).otherwise(p),
        lambda p: F.when(p.endswith("ed") & (n(p) > 4), cut(p, 2)).otherwise(p),
        strip,
    ]
    out = strip(F.lower(phrase))
    for step in steps:
        out = bind(out, step)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))
