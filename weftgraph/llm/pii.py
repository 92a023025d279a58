"""Personal data: exact base patterns, and further spans by weak supervision. DataFrame operations only.

Base spans are those of four patterns (e-mail, IP, card, phone) with their checks, always reported. The method
adds spans of two more kinds, secrets and account numbers. Candidates are runs of letters and
digits, with the text around them. Four labelers vote on each (+1, -1 or 0 for no opinion): the
form of known keys (regex), issuers' prefixes and key words before it (gazetteer), what stands next to it
(context), and the share of digits (shape). Votes are counted by pattern over all documents, at
most 3^4 patterns, and expectation-maximisation estimates each labeler's reliability from
those counts. Its posteriors, summed by the few values of the features, train a logistic span
classifier, which is applied as a column expression.

Patterns are written with look-behinds and possessive quantifiers where that gives the same matches in
time proportional to the text. Positions count code points, end exclusive.

Defined cases: null or empty text has no spans; without candidates nothing is trained or added; rows with equal
doc_id each have their row; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, two_columns

_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
EXTRA = ("secret", "account")
_RANK = {k: i for i, k in enumerate([*BASE, *EXTRA])}
SECRET_WORDS = "password|passwd|pwd|passphrase|token|secret|api.?key|access.?key|auth|bearer|credential"
ACCOUNT_WORDS = "account|acct|iban|konto|compte|cuenta|ssn|social security|passport|customer (?:no|number)"
_KEY = "(?i:password|passwd|pwd|passphrase|secret|token|key)"
#: What may be a secret or an account number: what follows a key word and a sign, groups of digits and capitals
#: joined by hyphens or spaces, and runs of 8 or more letters and digits with a digit. The first look-behind, of one
#: character, only spares most places the second.
CANDIDATE = (
    rf"(?<=[:=\x20\"'])(?<={_KEY}[ ]?[:=][ ]?[\"']?)[A-Za-z0-9!#$%&*+/=?^_~.-]{{5,}}+"
    r"|(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
    r"|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{8,}+"
)
#: What a text without digits holds if it has a candidate: only those behind a key word and a sign need no digit.
SIGNED = rf"[:=](?<={_KEY}[ ]?[:=])"
#: Characters kept before a candidate.
BEFORE = 24
PREFIXES = "AKIA|ASIA|AIza|ghp|gho|xox|sk_|pk_|eyJ"
LABELERS = ("v_regex", "v_gazetteer", "v_context", "v_shape")
#: What the classifier sees: indicator columns.
FEATURES = ("f_form", "f_prefix", "f_word", "f_quoted", "f_path", "f_mixed", "f_long", "f_digits")


#: Matches that are placed by one fold; the folds' sums are placed by another.
BLOCK = 64


def _matches(text: Column, pattern: str) -> Column:
    """value, size, gap, before and after of every match, from what the matches leave of the text.

    Both lists are bound once by the array of one element; within a lambda they would be made again for every match.
    """
    both = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("rest")))

    def items(b: Column) -> Column:
        rest = b["rest"]
        return F.transform(
            b["found"],
            lambda m, i: F.struct(m.alias("value"), F.length(m).alias("size"), F.length(F.get(rest, i)).alias("gap"), F.substring(F.get(rest, i), -BEFORE, BEFORE).alias("before"), F.substring(F.get(rest, i + 1), 1, 1).alias("after")),
        )

    return F.transform(both, items)[0]


_PLACED = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _placed(items: Column) -> Column:
    """start and end of every match: running sums in blocks of BLOCK, and a running sum over the blocks.

    A fold that appends copies what it has, so one over all matches would be quadratic; no fold here is longer than a block
    or the number of blocks, and the latter appends single numbers.
    """

    def block(begin: Column, own: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast(_PLACED).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + x["gap"]
            one = F.struct(at.alias("start"), (at + x["size"]).alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
            return F.struct((at + x["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(own, start, step, lambda acc: acc["out"])

    def whole(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda k: F.slice(own, k * BLOCK + 1, F.lit(BLOCK)))
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
        begins = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        both = F.array(F.struct(blocks.alias("b"), begins.alias("s")))
        return F.transform(both, lambda x: F.flatten(F.transform(x["b"], lambda b, k: block(F.get(x["s"], k), b))))[0]

    return F.when(F.size(items) == 0, F.array().cast(_PLACED)).otherwise(F.transform(F.array(items), whole)[0])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d >= "5", d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    size = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(size.between(14, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return size.between(10, 15)
    return F.lit(True)


def _checked(kind: str) -> Column:
    """start, rank and end of the matches of a base kind that pass its check."""
    valid = F.filter(kind, lambda s: _valid(kind, s["value"]))
    return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(_RANK[kind]).alias("rank"), s["end"].alias("end")))


def _found(docs: DataFrame) -> DataFrame:
    """One pass over the texts: spans of every base kind and the candidates of each document.

    Each is looked for where the text holds what every match of it needs: base kinds a character, candidates a digit or
    a key word and a sign.
    """
    text = F.col("text")
    has = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": F.col("_digit"), "card": F.col("_digit")}
    none = F.array().cast("array<struct<value:string,size:int,gap:int,before:string,after:string>>")
    rows = docs.withColumn("_digit", text.rlike("[0-9]"))
    rows = rows.select("doc_id", *[F.when(has[k], _matches(text, p)).otherwise(none).alias(k) for k, p in BASE.items()], F.when(F.col("_digit") | text.rlike(SIGNED), _matches(text, CANDIDATE)).otherwise(none).alias("candidates"))
    rows = rows.select("doc_id", *[_placed(F.col(k)).alias(k) for k in [*BASE, "candidates"]])
    kept = [_checked(k).alias(k) for k in BASE]
    return rows.select("doc_id", *kept, "candidates")


def features(c: Column) -> dict[str, Column]:
    """Of a candidate struct: the labelers' votes and the classifier's indicators."""
    value, before = c["value"], F.lower(c["before"])
    near = F.regexp_replace(c["before"], r"\s+$", "")
    last = F.substring(near, -1, 1)
    n_digits, size = F.length(_digits(value)), F.length(value)
    only_digits = n_digits == size
    hexa = value.rlike("^[0-9a-f]{16,}$") & ~only_digits
    issued = value.rlike("^(?:AKIA|ASIA)[0-9A-Z]{16}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$")
    prefix = value.rlike(f"^(?:{PREFIXES})")
    secret_word = before.rlike(rf"(?:{SECRET_WORDS})\W*(?:is|=|:)?\W*$")
    account_word = before.rlike(rf"(?:{ACCOUNT_WORDS})\W*(?:is|=|:|no|number)?\W*$")
    quoted, path = last.isin("=", '"', "'", ":"), last.isin("/", ".", "@", "-", "_")
    share = n_digits / size
    mixed = share.between(0.1, 0.9)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    return {
        "v_regex": vote(hexa | issued, only_digits | (size < 12)),
        "v_gazetteer": vote(prefix | secret_word | account_word, F.lit(False)),
        "v_context": vote(quoted, path),
        "v_shape": vote(mixed & (size >= 16), ~mixed),
        "f_form": (hexa | issued).cast("int"),
        "f_prefix": prefix.cast("int"),
        "f_word": (secret_word | account_word).cast("int"),
        "f_quoted": quoted.cast("int"),
        "f_path": path.cast("int"),
        "f_mixed": mixed.cast("int"),
        "f_long": (size >= 16).cast("int"),
        "f_digits": only_digits.cast("int"),
    }


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM over vote patterns: the prior, and per labeler and vote its chance in either class (0, 1)."""
    total = sum(n for _, n in counts)
    votes = len(counts[0][0])
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(p))) for p, _ in counts]
    for _ in range(rounds):
        weight = [sum(n * (1 - q) for q, (_, n) in zip(post, counts, strict=True)), sum(n * q for q, (_, n) in zip(post, counts, strict=True))]
        prior = (weight[1] + 1) / (total + 2)
        table = []
        for k in range(votes):
            own = {}
            for v in (-1, 0, 1):
                in1 = sum(n * q for q, (p, n) in zip(post, counts, strict=True) if p[k] == v)
                in0 = sum(n * (1 - q) for q, (p, n) in zip(post, counts, strict=True) if p[k] == v)
                # a labeler is assumed to be right more often than not: one pseudo-vote says so
                own[v] = ((in0 + (1.5 if v < 0 else 0.5)) / (weight[0] + 2.5), (in1 + (1.5 if v > 0 else 0.5)) / (weight[1] + 2.5))
            table.append(own)
        post = [posterior(prior, table, p) for p, _ in counts]
    return prior, table


def posterior(prior: float, table: list[dict[int, tuple[float, float]]], pattern: tuple[int, ...]) -> float:
    z = math.log(prior / (1 - prior)) + sum(math.log(t[v][1] / t[v][0]) for t, v in zip(table, pattern, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(rows: list[tuple[tuple[int, ...], float, float]], steps: int = 400, rate: float = 1.0, decay: float = 1e-3) -> list[float]:
    """Weights (the last is the bias) of rows of (indicators, positives, negatives)."""
    total = sum(p + n for _, p, n in rows)
    w = [0.0] * (len(rows[0][0]) + 1)
    for _ in range(steps):
        g = [decay * x for x in w[:-1]] + [0.0]
        for x, pos, neg in rows:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, w[-1] + sum(a * b for a, b in zip(w, x, strict=False))))))
            d = ((pos + neg) * q - pos) / total
            for k, value in enumerate(x):
                g[k] += d * value
            g[-1] += d
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
    return w


def train(found: DataFrame) -> list[float] | None:
    """The span classifier's weights, from counts over all candidates."""
    seen = found.select(F.explode("candidates").alias("c"))
    cols = {k: v.cast("int") for k, v in features(F.col("c")).items()}
    # 3^4 patterns times 2^8 indicators at most, far fewer in fact: bounded, whatever the corpus
    table = seen.select(*[v.alias(k) for k, v in cols.items()]).groupBy(*cols).agg(F.count("*").alias("n")).orderBy(*cols).collect()
    if not table:
        return None
    counts: dict[tuple[int, ...], int] = {}
    for r in table:
        p = tuple(r[k] for k in LABELERS)
        counts[p] = counts.get(p, 0) + r["n"]
    prior, own = reliabilities(sorted(counts.items()))
    rows = []
    for r in table:
        q = posterior(prior, own, tuple(r[k] for k in LABELERS))
        rows.append((tuple(r[k] for k in FEATURES), r["n"] * q, r["n"] * (1 - q)))
    return logistic(rows)


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans and all_spans (arrays of start, rank, end)."""
    found = cut(_found(two_columns(df, id_col, text_col)), "pii")
    weights = train(found)
    base = F.array_sort(F.concat(*BASE))
    if weights is None:
        added = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    else:

        def is_one(c: Column) -> Column:
            own = features(c)
            return sum((F.lit(w) * own[k] for w, k in zip(weights, FEATURES, strict=False)), F.lit(weights[-1])) > 0

        account = lambda c: F.lower(c["before"]).rlike(rf"(?:{ACCOUNT_WORDS})\W*(?:is|=|:|no|number)?\W*$")
        added = F.transform(F.filter("candidates", is_one), lambda c: F.struct(c["start"].alias("start"), F.when(account(c), _RANK["account"]).otherwise(_RANK["secret"]).alias("rank"), c["end"].alias("end")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, base.alias("base_spans"), F.array_sort(F.concat(base, added)).alias("all_spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in _RANK])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")
