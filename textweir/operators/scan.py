"""The scan: policy -> staged columns -> verdict, one shuffle-free pass.

A scan is a list of *stages*. A stage maps the columns of the stages before it
to new ones. Stages are materialised one by one: as projections of a DataFrame
(``scan``), or as struct fields of an array of sentences (``scan_array``). Each
expression is thus evaluated once, though the redacted text of one step is used
both by the next step and by the detectors.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import Plugin, external_message, injection_guard, score_message
from ..functions.keywords import has_keyword, joined_matches
from ..functions.redaction import (custom_rules, guard_columns, labels, loose_rules, no_labels,
                                   strict_rules)
from ..functions.rules import INJECTION_LABEL
from ..functions.similarity import Embedder, best_intent, embed, intent_label
from ..functions.entities import EntityRule, entity_rules
from ..functions.models import model_message
from ..functions.spans import Recognizer, no_spans, rewritten, rule_matches
from ..functions.verdict import verdict_columns
from ..policy import Policy, PolicyWarning

State = dict[str, Column]
Stage = Callable[[State], State]


@dataclass(frozen=True)
class Models:
    """What a policy needs beyond rules. Each part is optional.

    ``vector`` names a column of ready vectors, or ``embedder`` loads a model for
    the redacted text; ``intent_vectors`` holds the vectors of the intents (taken
    from the embedder when left out). ``score`` gives the toxicity score of a text, ``score_result`` a
    struct of score and error (``model_result``), where ``on_error`` says what an error means: 'open' (no
    finding), 'closed' (a finding) or 'raise'. ``plugins`` return a message or NULL.
    ``secrets`` are opt-in extra patterns. ``recognizer`` adds a model's spans to those of the entity rules;
    all spans are then resolved together.
    """

    vector: str | None = None
    embedder: Callable[[], Embedder] | None = None
    intent_vectors: Mapping[str, Sequence[float]] | None = None
    score: Callable[[Column], Column] | None = None
    plugins: Sequence[Plugin] = ()
    entities: bool = True
    persons: Sequence[str] = ()
    locations: Sequence[str] = ()
    secrets: Mapping[str, str] = field(default_factory=dict)
    score_result: Callable[[Column], Column] | None = None
    on_error: str | Column = "raise"
    recognizer: Recognizer | None = None


def span_stages(rules: Sequence[EntityRule], recognizer: Recognizer | None) -> list[Stage]:
    """Spans of the rules and the recognizer, found apart, resolved and replaced together."""
    kinds = list(dict.fromkeys([*(r.name for r in rules), *(recognizer.kinds if recognizer else ())]))
    on_error = recognizer.on_error if recognizer else "raise"
    kinds += ["TEXT"] if on_error == "closed" else []

    def find(state: State) -> State:
        return {"matches": rule_matches(state["text"], rules),
                "found": recognizer.find(state["text"]) if recognizer else no_spans()}

    def resolve(state: State) -> State:
        return {"spans": rewritten(state["text"], rules, state["matches"], state["found"], on_error)}

    def replace(state: State) -> State:
        hits = {f"hit_PII:{k}_{n}": F.coalesce(F.array_contains(state["spans"]["kinds"], k), F.lit(False))
                for n, k in enumerate(kinds)}
        return {"text": F.coalesce(state["spans"]["text"], state["text"]), **hits}

    return [find, resolve, replace]


def redaction_stages(policy: Policy, models: Models) -> list[Stage]:
    """One stage per redaction rule; without entity support the patterns are used."""
    rules: list[tuple[str, object]] = []  # (label, rule)
    first: list[Stage] = []
    if policy.pii_enabled:
        if policy.pii_engine == "entities" and models.entities and models.recognizer:
            first, found = span_stages(entity_rules(models.persons, models.locations), models.recognizer), []
        elif policy.pii_engine == "entities" and models.entities:
            found = entity_rules(models.persons, models.locations)
        else:
            found = strict_rules(policy.pii_patterns)
        rules += [(f"PII:{r.name}", r) for r in found]
    for kind, pattern in models.secrets.items():
        rules += [(f"Secret:{kind}", custom_rules({"SECRET": pattern})[0])]

    def stage(label: str, rule) -> Stage:
        def run(state: State) -> State:
            after = rule.replace(state["text"], _guards(state))
            key = f"hit_{label}_{sum(k.startswith('hit_') for k in state)}"
            return {"text": after, key: rule.hit(state["text"], after)}
        return run

    return [*first, _guard_stage([r for _, r in rules]), *(stage(label, rule) for label, rule in rules)]


def _guard_stage(rules: Sequence) -> Stage:
    return lambda state: {f"guard_{k}": c for k, c in guard_columns(rules, state["text"]).items()}


def _guards(state: State) -> dict[str, Column]:
    return {k[6:]: c for k, c in state.items() if k.startswith("guard_")}


def _hits(state: State, kind: str) -> list[tuple[str, Column]]:
    return [(k[4:].rsplit("_", 1)[0], c) for k, c in state.items() if k.startswith(f"hit_{kind}")]


def lower_stage(state: State) -> State:
    """The lower-cased text, once."""
    return {} if "low" in state else {"low": F.lower(state["text"])}


def detector_stages(policy: Policy, source: Column, models: Models) -> list[Stage]:
    """The detectors behind redaction, in their fixed order; none stops another."""
    is_input = source == "input"
    stages: list[Stage] = []
    detectors: dict[str, Callable[[State], Column]] = {}
    if policy.injection_enabled or policy.topics or policy.external_enabled:
        stages.append(lower_stage)
    if policy.injection_enabled:
        detectors["label_injection"] = lambda s: F.when(
            is_input & has_keyword(s["text"], policy.effective_keywords, s["low"]), F.lit(INJECTION_LABEL))
    if policy.topics:
        detectors["label_topic"] = lambda s: F.concat(
            F.lit("Topic:"), joined_matches(s["text"], policy.topics, ",", s["low"]))
    intents = _intent_vectors(policy, models) if policy.semantic_enabled else None
    if intents:
        if models.vector is None:
            # the condition is on the argument: a UDF runs for every row that it is given
            stages.append(lambda s: {"vector": embed(F.when(is_input, s["text"]), models.embedder)})
        stages.append(lambda s: {"best": F.when(is_input, best_intent(
            s["vector"] if models.vector is None else F.col(models.vector), intents))})
        detectors["label_semantic"] = lambda s: intent_label(s["best"], policy.semantic_threshold)
    if policy.external_enabled:
        detectors["label_external"] = lambda s: F.when(is_input, external_message(
            s["text"], policy.competitors, policy.toxicity_check, s["low"]))
    plugins: list[Plugin] = []
    if policy.toxicity_enabled:
        if models.score_result is not None:
            stages.append(lambda s: {"model": models.score_result(s["text"])})
            detectors["label_model"] = lambda s: F.concat(
                F.lit("Plugin:"), model_message(s["model"], policy.toxicity_threshold, models.on_error))
        elif models.score is None:
            warnings.warn(f"{policy.name}: no scoring model given, toxicity score skipped",
                          PolicyWarning, stacklevel=3)
        else:
            plugins.append(lambda t: score_message(models.score(t), policy.toxicity_threshold))
    plugins += models.plugins
    for n, plugin in enumerate(plugins):
        detectors[f"label_plugin{n}"] = lambda s, p=plugin: F.concat(F.lit("Plugin:"), p(s["text"]))

    def detect(state: State) -> State:
        return {key: label(state) for key, label in detectors.items()}

    # A label column is NULL when its detector is silent.
    def collect(state: State) -> State:
        pii = labels(_hits(state, "PII:"))
        other = [labels(_hits(state, "Secret:"))] if models.secrets else []
        other += [F.when(state[k].isNotNull(), F.array(state[k])).otherwise(no_labels()) for k in detectors]
        score = F.coalesce(state["best"]["score"], F.lit(0.0)) if "best" in state else F.lit(0.0)
        return {"pii": pii, "rules": F.concat(*other) if other else no_labels(), "score": score}

    return [*stages, detect, collect]


def _intent_vectors(policy: Policy, models: Models) -> Mapping[str, Sequence[float]] | None:
    intents = policy.effective_intents
    if models.intent_vectors is not None:
        return {n: models.intent_vectors[n] for n in intents if n in models.intent_vectors} or None
    if models.embedder is not None:
        return dict(zip(intents, models.embedder().encode(intents).tolist()))
    warnings.warn(f"{policy.name}: no embedding model given, semantic blocking skipped",
                  PolicyWarning, stacklevel=4)
    return None


def verdict_stage(policy: Policy) -> Stage:
    def run(state: State) -> State:
        triggered = F.concat(state["pii"], state["rules"])
        cols = verdict_columns(triggered, F.size(state["rules"]) > 0, F.lit(policy.shadow_mode))
        return {"triggered": triggered, **cols}
    return run


def redaction_key(policy: Policy) -> tuple:
    """Equal for policies whose redaction steps are the same."""
    return (policy.pii_engine, policy.pii_patterns) if policy.pii_enabled else ()


def all_stages(policy: Policy, source: Column, models: Models) -> list[Stage]:
    return [*redaction_stages(policy, models), *detector_stages(policy, source, models),
            verdict_stage(policy)]


_ids = itertools.count()


def run_stages(df: DataFrame, state: State, stages: Sequence[Stage]) -> tuple[DataFrame, State]:
    """Add the stage columns to ``df`` under private names, one projection per stage."""
    df, (state,) = run_parallel(df, [(state, stages)])
    return df, state


def run_parallel(df: DataFrame, jobs: Sequence[tuple[State, Sequence[Stage]]]) -> tuple[DataFrame, list[State]]:
    """``run_stages`` for several lists of stages; their n-th stages share a projection."""
    tag = f"__scan{next(_ids)}_"
    states = [dict(state) for state, _ in jobs]
    for n in range(max(len(stages) for _, stages in jobs)):
        made = [stages[n](state) if n < len(stages) else {} for state, (_, stages) in zip(states, jobs)]
        named = [{key: f"{tag}{n}_{j}_{i}" for i, key in enumerate(new)} for j, new in enumerate(made)]
        columns = {names[key]: col for names, new in zip(named, made) for key, col in new.items()}
        if columns:
            df = df.withColumns(columns)
        for state, names in zip(states, named):
            state |= {key: F.col(name) for key, name in names.items()}
    return df, states


def seal(df: DataFrame, keep: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with ``keep`` and ``columns``, closed to filters on the latter.

    The optimizer moves a filter below projections by copying the filtered column's
    definition into it, each stage into the next: every pattern would run many
    times per row. Filters stop at generated columns, hence the one-row ``inline``;
    filters on ``keep`` still go down to the scan of the table.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def as_source(source: str | Column) -> Column:
    if isinstance(source, str):
        if source not in ("input", "output"):
            raise ValueError("source is 'input', 'output' or a column of these")
        return F.lit(source)
    return source


def result_columns(state: State) -> dict[str, Column]:
    return {"sanitized_text": state["text"], "triggered": state["triggered"],
            "semantic_score": state["score"], "valid": state["valid"],
            "reason": state["reason"], "action": state["action"]}


def scan(df: DataFrame, policy: Policy, text_col: str = "text", source: str | Column = "input",
         models: Models = Models()) -> DataFrame:
    """``df`` plus ``sanitized_text, triggered, semantic_score, valid, reason, action``.

    ``source`` may be a column, so both directions run in one pass.
    """
    keep = df.columns
    out, state = run_stages(df, {"text": F.col(text_col)}, all_stages(policy, as_source(source), models))
    return seal(out, keep, result_columns(state))


def validate_input(df: DataFrame, policy: Policy, text_col: str = "text",
                   models: Models = Models()) -> DataFrame:
    return scan(df, policy, text_col, "input", models)


def validate_output(df: DataFrame, policy: Policy, text_col: str = "text",
                    models: Models = Models()) -> DataFrame:
    """Output skips the injection, semantic and external detectors."""
    return scan(df, policy, text_col, "output", models)


def redact(df: DataFrame, rules: Sequence, text_col: str = "text") -> DataFrame:
    """``df`` plus ``sanitized_text`` and ``redacted_types`` (rule names that hit, in order)."""
    def stage(n: int, rule) -> Stage:
        def run(state: State) -> State:
            after = rule.replace(state["text"], _guards(state))
            return {"text": after, f"hit{n}": rule.hit(state["text"], after)}
        return run

    keep = df.columns
    stages = [_guard_stage(rules), *(stage(n, r) for n, r in enumerate(rules))]
    out, state = run_stages(df, {"text": F.col(text_col)}, stages)
    names = labels((r.name, state[f"hit{n}"]) for n, r in enumerate(rules))
    return seal(out, keep, {"sanitized_text": state["text"], "redacted_types": names})


def redact_entities(df: DataFrame, rules: Sequence[EntityRule], recognizer: Recognizer | None = None,
                    text_col: str = "text") -> DataFrame:
    """``df`` plus ``sanitized_text`` and ``redacted_types`` (kinds that were found, in order), spans resolved together."""
    keep = df.columns
    out, state = run_stages(df, {"text": F.col(text_col)}, span_stages(rules, recognizer))
    names = labels((k[len("hit_PII:"):].rsplit("_", 1)[0], c) for k, c in state.items() if k.startswith("hit_PII:"))
    return seal(out, keep, {"sanitized_text": state["text"], "redacted_types": names})


def pii_guard(df: DataFrame, rules: Sequence, text_col: str = "text") -> DataFrame:
    """Stand-alone redaction guard: always valid; action ``redacted`` or ``none``."""
    out = redact(df, rules, text_col)
    hit = F.size("redacted_types") > 0
    return out.withColumns({
        "valid": F.lit(True),
        "reason": F.when(hit, F.lit("PII Redacted")).otherwise(F.lit("No PII found")),
        "action": F.when(hit, F.lit("redacted")).otherwise(F.lit("none")),
    })


def legacy_gateway_validate(df: DataFrame, text_col: str = "text",
                            keywords: Sequence[str] = ()) -> DataFrame:
    """Older order: an injection substring blocks and leaves the text as it is;
    otherwise the loose patterns are redacted and the action is always ``allowed``."""
    keep = df.columns
    out = redact(df, loose_rules(), text_col)
    passed = injection_guard(F.col(text_col), keywords)["valid"]
    return out.withColumn("__ok", passed).select(
        *keep, F.col("__ok").alias("valid"),
        F.when(F.col("__ok"), F.col("sanitized_text")).otherwise(F.col(text_col)).alias("sanitized_text"),
        F.when(F.col("__ok"), F.lit("Passed")).otherwise(F.lit("Prompt Injection Detected")).alias("reason"),
        F.when(F.col("__ok"), F.lit("allowed")).otherwise(F.lit("blocked")).alias("action"))


def needs_rows(policy: Policy, models: Models) -> bool:
    """Whether a policy runs a model, which needs one row per text and cannot work inside an array."""
    return bool(policy.toxicity_enabled and (models.score or models.score_result)
                or policy.pii_enabled and policy.pii_engine == "entities" and models.entities and models.recognizer)


def scan_array(df: DataFrame, array_col: str, policy: Policy, out_col: str,
               models: Models = Models()) -> DataFrame:
    """Validate every element of a string array as *output*, row by row, no shuffle.

    ``out_col`` becomes an array of structs ``(original, text, triggered, valid,
    reason, action)``. Every stage is one ``transform`` over the array, so a scoring model or a
    recognizer, which need not be a built-in expression, cannot take part.
    """
    if needs_rows(policy, models):
        raise ValueError("a model needs one row per text: use scan on the exploded array")
    if policy.semantic_enabled or models.vector:  # output skips it
        models = Models(plugins=models.plugins, entities=models.entities, persons=models.persons,
                        locations=models.locations, secrets=models.secrets)
    stages = all_stages(policy, F.lit("output"), models)
    cur = f"__arr{next(_ids)}"
    df = df.withColumn(cur, F.transform(array_col, lambda s: F.struct(s.alias("original"), s.alias("text"))))
    fields = ["original", "text"]

    def step(stage: Stage, fields: list[str]) -> tuple[Callable[[Column], Column], list[str]]:
        out_fields = list(fields)

        def run(item: Column) -> Column:
            state = {f: item[f] for f in fields}
            new = stage(state)
            merged = {**state, **new}
            out_fields[:] = list(merged)
            return F.struct(*[c.alias(k) for k, c in merged.items()])
        return run, out_fields

    for stage in stages:
        run, out_fields = step(stage, fields)
        df = df.withColumn(cur, F.transform(cur, run))
        fields = out_fields
    wanted = ("original", "text", "triggered", "valid", "reason", "action")
    return df.withColumn(out_col, F.transform(cur, lambda s: F.struct(*[s[w].alias(w) for w in wanted]))).drop(cur)
