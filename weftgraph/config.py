"""Session configuration as plain dictionaries: filters, budgets, validation, migration, prompts. Driver side, a few KB."""

from __future__ import annotations

import copy
from typing import Any, NamedTuple

from weftgraph.operators.scenario import LENGTHS, STYLES, fit_budget

# The relations' labels, ranges of thresholds, the defaults of two prompts.
RELATIONS = (
    "prerequisite", "contrast", "elaboration", "example_of", "shared_concept",
    "conditional_behavior", "operation_comparison", "generalization_pattern", "convergent_goal", "complementary_aspect",
)
RANGES = {
    "evaluation.qa_eval_threshold": (0.0, 1.0),
    "evaluation.relation_validator_confidence_threshold": (0.0, 1.0),
    "evaluation.discovery_min_confidence": (0.0, 1.0),
    "evaluation.scenario_buffer_ratio": (0.0, 2.0),
    "kg_enrichment.cosine_sim_min": (0.0, 1.0),
    "kg_enrichment.cosine_sim_max": (0.0, 1.0),
    "kg_enrichment.jaccard_kp_threshold": (0.0, 1.0),
    "kg_enrichment.idf_threshold": (0.0, 20.0),
}
DEFAULT_PROMPTS = {
    "query_generation": "Ask one question that can only be answered with both contexts.",
    "answer_generation": "Answer the question with facts of both contexts only.",
}
SESSION_PROMPTS = ("keyphrase_extractor", "qualify_system", "qualify_user_template")


class Issue(NamedTuple):
    severity: str
    field: str
    message: str


def at(config: dict, path: str, default: Any = None) -> Any:
    """The value under a dotted path."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def deep_merge(base: dict, patch: dict) -> dict:
    """base with patch in it, dictionaries merged, neither changed."""
    out = dict(base)
    for k, v in patch.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def expand_dots(flat: dict) -> dict:
    """{"a.b": 1} as {"a": {"b": 1}}; keys that meet are merged."""
    out: dict = {}
    for key, value in flat.items():
        for part in reversed(key.split(".")):
            value = {part: value}
        out = deep_merge(out, value)
    return out


def update(config: dict, flat: dict) -> dict:
    return deep_merge(config, expand_dots(flat))


def layered(flags: dict, session: dict, environment: dict, defaults: dict) -> dict:
    """Flags before session before environment before defaults; None says nothing."""
    out = {}
    for layer in (defaults, environment, session, flags):
        out |= {k: v for k, v in layer.items() if v is not None}
    return out


def allow_types(config: dict, allowed: list[str] | None) -> dict:
    """Only allowed question types, their budget shared out anew; if none is known, nothing changes."""
    types = [t for t in at(config, "taxonomy.types", []) if t["name"] in (allowed or [])]
    if not types:
        return config
    names = {t["name"] for t in types}
    budget = {k: v for k, v in at(config, "taxonomy.budget", {}).items() if k in names}
    return config | {"taxonomy": {**config["taxonomy"], "types": types, "budget": fit_budget(budget) if budget else {}}}


def keep_named(items: list, wanted: list[str] | None, name=lambda x: x) -> list:
    """The wanted ones of personas, styles or lengths; all if none of them is there."""
    return [x for x in items if name(x) in (wanted or [])] or list(items)


def budget_is_whole(budget: dict[str, float], slack: float = 0.01) -> bool:
    return abs(sum(budget.values()) - 1) <= slack + 1e-9


def validate(config: dict) -> list[Issue]:
    """What is wrong (error) or odd (warning) with a configuration; an empty list: nothing."""
    found: list[Issue] = []

    def say(severity: str, field: str, message: str) -> None:
        found.append(Issue(severity, field, message))

    types = [t["name"] for t in at(config, "taxonomy.types", [])]
    budget = at(config, "taxonomy.budget", {})
    if not budget_is_whole(budget, 0.02):
        say("error", "taxonomy.budget", f"shares sum to {sum(budget.values()):.4f}, not to 1")
    for t, share in budget.items():
        if t not in types:
            say("error", f"taxonomy.budget.{t}", "no such question type")
        if not 0 <= share <= 1:
            say("error", f"taxonomy.budget.{t}", f"{share} is no share")
    for t in types:
        if t not in budget:
            say("warning", "taxonomy.budget", f"type {t} has no share")
    if len(types) < 2:
        say("error", "taxonomy.types", "fewer than 2 question types")
    mapped = at(config, "taxonomy.relation_to_question_types", {})
    for relation, of in mapped.items():
        if relation not in RELATIONS:
            say("warning", f"taxonomy.relation_to_question_types.{relation}", "no known relation")
        for t in of:
            if t not in types:
                say("error", f"taxonomy.relation_to_question_types.{relation}", f"no question type {t}")
    for relation in RELATIONS[:5]:
        if relation not in mapped:
            say("warning", "taxonomy.relation_to_question_types", f"relation {relation} has no types")
    personas = {p["name"] for p in config.get("personas") or []}
    if not personas:
        say("error", "personas", "no persona")
    for example in at(config, "few_shots.query_generation", []):
        name = (example.get("input") or {}).get("persona_name", "")
        if name and name not in personas:
            say("warning", "few_shots.query_generation", f"no persona {name}")
    for field, (low, high) in RANGES.items():
        value = at(config, field)
        if value is not None and not low <= value <= high:
            say("error", field, f"{value} is not within {low} and {high}")
    low, high = at(config, "kg_enrichment.cosine_sim_min"), at(config, "kg_enrichment.cosine_sim_max")
    if low is not None and high is not None and low >= high:
        say("error", "kg_enrichment", f"cosine_sim_min {low} is not below cosine_sim_max {high}")
    if at(config, "evaluation.max_retry", 0) < 0:
        say("error", "evaluation.max_retry", "below 0")
    if at(config, "evaluation.max_context_chars", 12000) < 1000:
        say("warning", "evaluation.max_context_chars", "below 1000")
    for field, known in (("styles", STYLES), ("lengths", LENGTHS)):
        for x in at(config, f"query_params.{field}", []):
            if x not in known:
                say("warning", f"query_params.{field}", f"{x} is unknown")
    template = at(config, "prompts.qualify_user_template")
    if template is not None:
        if any(f"{{context_{k}}}" not in template for k in (1, 2)):
            say("error", "prompts.qualify_user_template", "needs {context_1} and {context_2}")
        try:
            template.format(context_1="", context_2="")
        except (KeyError, IndexError, ValueError) as error:
            say("error", "prompts.qualify_user_template", f"is no format string: {error}")
    return found


LEGACY = "query_answer_generation"


def migrate(config: dict) -> dict:
    """The single prompt for question and answer as two, its examples shared out; a new configuration stays as it is."""
    out = copy.deepcopy(config)
    if LEGACY in (out.get("prompts") or {}):
        del out["prompts"][LEGACY]
        out["prompts"] = DEFAULT_PROMPTS | out["prompts"]
    if LEGACY in (out.get("few_shots") or {}):
        questions, answers = [], []
        for example in filter(lambda e: isinstance(e, dict), out["few_shots"].pop(LEGACY) or []):
            given, made = example.get("input") or {}, example.get("output") or {}
            context = given.get("context") or [given[k] for k in ("context_1", "context_2") if given.get(k)]
            questions.append({"input": given, "output": {"query": made.get("query", "")}})
            answers.append({"input": {"context": context, "question": made.get("query", ""), "themes": given.get("themes", [])}, "output": {"answer": made.get("answer", "")}})
        out["few_shots"] = {"query_generation": questions, "answer_generation": answers} | out["few_shots"]
    return out


def resync_prompts(config: dict, current: dict[str, str]) -> tuple[dict, list[str]]:
    """The configuration with the current prompts in place of its copies, and which of them changed; a session's own stay."""
    out = copy.deepcopy(config)
    prompts = {k: v for k, v in (out.get("prompts") or {}).items() if k != LEGACY}
    shared = {k: v for k, v in current.items() if k not in SESSION_PROMPTS}
    changed = [k for k, v in shared.items() if prompts.get(k) != v]
    out["prompts"] = prompts | shared
    return out, changed


def prompt(instruction: str, examples: list[dict], inputs: list[str], outputs: list[str]) -> dict:
    """A prompt as data: its instruction, and those examples that have all fields of both sides."""
    whole = [e for e in examples if all(k in (e.get("input") or {}) for k in inputs) and all(k in (e.get("output") or {}) for k in outputs)]
    return {"instruction": instruction, "inputs": inputs, "outputs": outputs, "examples": whole}


def resolve_personas(examples: list[dict], personas: list[dict]) -> list[dict]:
    """Examples whose persona_name is replaced by the persona itself; unknown names keep only their name."""
    by = {p["name"]: p for p in personas}
    out = []
    for e in examples:
        given = dict(e.get("input") or {})
        if "persona_name" in given:
            name = given.pop("persona_name")
            given["persona"] = by.get(name, {"name": name, "role_description": ""})
        out.append({"input": given, "output": e.get("output") or {}})
    return out
