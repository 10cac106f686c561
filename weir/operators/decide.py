"""Triage decisions from rule tables, and the judging of scores and decisions against expectations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import held, runs_of
from ..functions.text import NEGATION, lang_tag, mask_terms, mode_of, mode_runs, norm_key, split_clauses, strip_markup
from .joins import fresh_only
from .ranking import assign_ids, bm25f, dedupe_first, nominate, top_k
from .sets import ordered_union as ordered_union_of


@dataclass(frozen=True)
class Forbidden:
    """What a decision forbids its consumer: tools that are never allowed, and actions that only the mode implement allows."""

    always: tuple[str, ...] = ()
    unless_implement: tuple[str, ...] = ("modify_files", "install_tools", "execute_target")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


@dataclass(frozen=True)
class Domain:
    """Rules of one domain. The order of domains in a rule set is the order of arbitration."""

    name: str
    triggers: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    quality: tuple[str, ...] = ()
    negatives: tuple[str, ...] = ()
    members: tuple[str, ...] = ()
    default_recipe: str = ""


@dataclass(frozen=True)
class RuleSet:
    domains: tuple[Domain, ...]
    #: Domains of which both sides at once mean a mixed request, unless `bridge` is there as well.
    conflict: tuple[str, tuple[str, ...], str] | None = None
    ready: frozenset[str] = frozenset()  # members that are available
    recipes: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    forbidden: Forbidden = Forbidden()

    def __post_init__(self):
        if len({d.name for d in self.domains}) < len(self.domains):
            raise ValueError("a domain is named twice")
        if unknown := {d.default_recipe for d in self.domains if d.default_recipe} - set(self.recipes):
            raise ValueError(f"no such recipes: {sorted(unknown)}")


def prepare(df: DataFrame, text: str) -> DataFrame:
    """df with _text (markup stripped), _active (clauses that aren't negated), _negated (the others, by line) and mode.

    Each is a column of its own, so that a text is cut into clauses once, however many terms are looked up.
    """
    df = df.withColumn("_text", strip_markup(F.col(text)))
    df = df.withColumns({"_negates": F.col("_text").rlike(NEGATION), "_runs": mode_runs(F.col("_text"))})
    active, negated = split_clauses(F.col("_text"), F.col("_negates"))
    return df.withColumns({"_active": active, "_negated": negated, "mode": mode_of(F.col("_text"), F.col("_runs"))}).drop("_runs", "_negates")


def domain_scores(df: DataFrame, rules: RuleSet, text: str = "text") -> DataFrame:
    """df with scores: for each domain, in order, strong (trigger and quality terms), weak (terms), score, gate and named.

    Negative words are written over before terms are counted. A member named outside negated clauses counts 2 for its
    domain; one named in a negated clause is excluded. The rules are a policy, not data: a text is cut into words once
    (once more for a domain whose negative words it has), and all terms are looked up among these.
    """
    df = prepare(df, text)
    members = [m for d in rules.domains for m in d.members]
    plain = [t for d in rules.domains for t in (*d.quality, *d.members, *d.triggers, *d.weak)]
    df = df.withColumns({"_of_active": runs_of(F.col("_active"), plain), "_of_negated": runs_of(F.col("_negated"), members)})
    for i, d in enumerate(rules.domains):
        if d.negatives:
            df = df.withColumn(f"_masked{i}", mask_terms(F.col("_active"), d.negatives))
            masked = runs_of(F.col(f"_masked{i}"), [*d.triggers, *d.quality, *d.weak])
            df = df.withColumn(f"_of_masked{i}", F.when(F.col(f"_masked{i}") != F.col("_active"), masked).otherwise(F.col("_of_active")))
    out = []
    for i, d in enumerate(rules.domains):
        scored = (F.col(f"_masked{i}"), F.col(f"_of_masked{i}")) if d.negatives else (F.col("_active"), F.col("_of_active"))
        strong = F.size(held(*scored, [*d.triggers, *d.quality]))
        weak = held(*scored, d.weak)
        excluded = held(F.col("_negated"), F.col("_of_negated"), d.members)
        named = F.array_except(held(F.col("_active"), F.col("_of_active"), d.members), excluded)
        gate = F.size(held(F.col("_active"), F.col("_of_active"), d.quality)) > 0
        out.append(F.struct(F.lit(d.name).alias("domain"), (strong + 2 * F.size(named)).alias("strong"), (strong + F.size(weak) + 2 * F.size(named)).alias("score"), weak.alias("weak"), gate.alias("gate"), named.alias("named"), excluded.alias("excluded")))
    return df.withColumn("scores", F.array(*out)).drop("_negated", "_of_active", "_of_negated", *(f"{k}{i}" for i in range(len(rules.domains)) for k in ("_masked", "_of_masked")))


def pick_domain(scored: DataFrame, rules: RuleSet) -> DataFrame:
    """scored with domain (mixed for a conflict, none without evidence) and pick, its scores.

    A quality gate comes first, then the first domain with strong evidence, then the first with any.
    """
    positive = lambda name: F.exists("scores", lambda s: (s["domain"] == name) & (s["score"] > 0))
    first = lambda test: F.get(F.filter("scores", test), F.lit(0))
    gate = first(lambda s: s["gate"] & (s["score"] > 0))
    strong, any_ = first(lambda s: s["strong"] > 0), first(lambda s: s["score"] > 0)
    conflict = F.lit(False)
    if rules.conflict:
        one, others, bridge = rules.conflict
        other = F.lit(False)
        for o in others:
            other = other | positive(o)
        conflict = positive(one) & other & ~positive(bridge)
    pick = F.coalesce(gate, strong, any_)
    return scored.withColumns({"pick": F.when(~conflict, pick), "domain": F.when(conflict, "mixed").otherwise(F.coalesce(pick["domain"], F.lit("none")))})


def lexical_picks(df: DataFrame, docs: DataFrame | None, rules: RuleSet, id_col: str, k: int = 5) -> DataFrame:
    """df with lexical: the nominated documents (name, norm) of the active text, ready and not excluded, best first.

    docs: (name, triggers, description); a name is a member of some domain.
    """
    kind = "array<struct<name:string,norm:double>>"
    if docs is None:
        return df.withColumn("lexical", F.array().cast(kind))
    fields = {"name": (F.col("name"), 3.0), "triggers": (F.array_join("triggers", " "), 2.0), "description": (F.col("description"), 1.0)}
    scored = nominate(bm25f(df.select(F.col(id_col).alias("_q"), "_active"), docs, fields, query_id="_q", query_text="_active", doc_id="name"))
    excluded = df.select(F.col(id_col).alias("qid"), F.explode(F.flatten(F.transform("scores", lambda s: s["excluded"]))).alias("doc"))
    scored = scored.join(excluded, ["qid", "doc"], "left_anti").filter(F.col("doc").isin(*sorted(rules.ready)))
    best = top_k(scored, ["qid"], "score", k, ["doc"]).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("doc").alias("name"), "norm"))), lambda x: F.struct(x["name"].alias("name"), x["norm"].alias("norm"))).alias("lexical"))
    return df.join(best.withColumnRenamed("qid", id_col), id_col, "left").withColumn("lexical", F.coalesce("lexical", F.array().cast(kind)))


def triage(df: DataFrame, rules: RuleSet, docs: DataFrame | None = None, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, mode, domain, confidence, action, candidates, must_not, reasons, …): an explained decision for each row.

    No domain: ask with the lexical candidates, or hand off. Weak evidence alone: ask, low. Strong: high from a score
    of 2 on, else medium, and dispatch (assemble_recipe may still turn that into a question).
    """
    rows = lexical_picks(pick_domain(domain_scores(df, rules, text), rules), docs, rules, id_col)
    members = F.create_map(*(x for d in rules.domains for x in (F.lit(d.name), _strings([m for m in d.members if m in rules.ready]))))
    excluded = F.flatten(F.transform("scores", lambda s: s["excluded"]))
    own = F.array_except(F.coalesce(members[F.col("domain")], F.array().cast("array<string>")), excluded)
    lexical = F.transform("lexical", lambda x: x["name"])
    said = F.array_join(F.transform("lexical", lambda x: F.format_string("%s@%.2f", x["name"], x["norm"])), ", ")
    mixed = F.array_except(F.flatten(F.transform(F.filter("scores", lambda s: s["score"] > 0), lambda s: F.coalesce(members[s["domain"]], F.array().cast("array<string>")))), excluded)
    named = F.flatten(F.transform("scores", lambda s: s["named"]))
    empty = F.trim("_text") == ""
    none, conflict = F.col("domain") == "none", F.col("domain") == "mixed"
    strong = (F.col("pick.strong") > 0) | F.col("pick.gate")
    missing = F.filter(named, lambda m: ~m.isin(*sorted(rules.ready))) if rules.ready else named
    lost = F.size(missing) > 0
    action = F.when(empty, "handoff").when(lost, "ask").when(conflict, "ask").when(none, F.when(F.size("lexical") > 0, "ask").otherwise("handoff")).when(strong, "dispatch").otherwise("ask")
    confidence = F.when(empty | lost | none, "none").when(conflict, "medium").when(~strong, "low").when(F.col("pick.score") >= 2, "high").otherwise("medium")
    candidates = F.when(empty | lost, F.array().cast("array<string>")).when(conflict, F.array_distinct(mixed)).when(none, lexical).when(strong, ordered_union_of(own, lexical)).otherwise(ordered_union_of(lexical, own))
    reasons = (
        F.when(empty, F.array(F.lit("empty_hint")))
        .when(lost, F.array(F.concat(F.lit("skill_unavailable: "), missing[0])))
        .when(conflict, F.array(F.lit("incompatible_primary_domains")))
        .when(none & (F.size("lexical") > 0), F.array(F.concat(F.lit("lexical_fallback: "), said)))
        .when(none, F.array(F.lit("no_domain_triggers_matched")))
        .when(~strong, F.array(F.concat(F.lit("weak_trigger_only: "), F.array_join("pick.weak", ", "))))
        .otherwise(F.concat(F.transform(named, lambda m: F.concat(F.lit("explicit_skill_hit: "), m)), F.when(F.size("lexical") > 0, F.array(F.concat(F.lit("lexical_candidates: "), said))).otherwise(F.array().cast("array<string>")), F.array(F.concat(F.lit("domain_selected: "), F.col("domain")))))
    )
    must_not = F.when(F.col("mode") == "implement", _strings(rules.forbidden.always)).otherwise(_strings([*rules.forbidden.always, *rules.forbidden.unless_implement]))
    out = rows.withColumns({"action": action, "confidence": confidence, "candidates": candidates, "reasons": reasons, "must_not": must_not, "domain": F.when(empty | lost, "none").otherwise(F.col("domain"))})
    return out.drop("_text", "scores", "pick", "lexical")


def assemble_recipe(decisions: DataFrame, recipes: DataFrame, flags: Mapping[str, Sequence[str]], rules: RuleSet, id_col: str = "id", active: str = "_active") -> DataFrame:
    """decisions with recipe and members; a dispatch whose members aren't all ready, or without any, becomes a question.

    flags: name -> terms that set it. recipes: (domain, recipe, flag or null, member, ord): the first recipe by ord
    whose flag is set (or that needs none) is chosen; its rows give members, and rows of recipe '+' add members where
    their flag is set. A small table of rules: one row a domain is broadcast.
    """
    rows = decisions.withColumn("_runs", runs_of(F.col(active), [t for terms in flags.values() for t in terms]))
    set_ = F.array_compact(F.array(*(F.when(F.size(held(F.col(active), F.col("_runs"), terms)) > 0, F.lit(name)) for name, terms in flags.items()))) if flags else F.array().cast("array<string>")
    rows = rows.withColumn("_flags", set_).drop("_runs")
    # a row's recipes come to it, so that what it was decided by is worked out once
    policy = recipes.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("ord", "member", "recipe", "flag"))).alias("_recipes"))
    fits = F.filter("_recipes", lambda r: r["flag"].isNull() | F.array_contains("_flags", r["flag"]))
    out = rows.join(F.broadcast(policy), "domain", "left").select(*rows.columns, fits.alias("_fits"))
    out = out.withColumn("recipe", F.get(F.filter("_fits", lambda r: (r["recipe"] != "+") & r["ord"].isNotNull()), F.lit(0))["recipe"])
    members = F.array_distinct(F.transform(F.filter("_fits", lambda r: (r["recipe"] == F.col("recipe")) | (r["recipe"] == "+")), lambda r: r["member"]))
    out = out.withColumn("members", F.when(F.col("recipe").isNotNull(), members).otherwise(F.array().cast("array<string>"))).drop("_fits")
    lost = F.filter("members", lambda m: ~m.isin(*sorted(rules.ready))) if rules.ready else F.col("members")
    go = F.col("action") == "dispatch"
    bad = go & ((F.size(lost) > 0) | (F.size("members") == 0))
    why = F.when(F.size(lost) > 0, F.concat(F.lit("recipe_unavailable: "), F.array_join(lost, ", "))).otherwise("missing_recipe")
    return out.withColumns({
        "reasons": F.when(bad, F.array_append("reasons", why)).otherwise(F.col("reasons")),
        "candidates": F.when(go & ~bad, ordered_union_of(F.col("candidates"), F.col("members"))).otherwise(F.col("candidates")),
        "recipe": F.when(go & ~bad, F.col("recipe")).otherwise(""),
        "members": F.when(go & ~bad, F.col("members")).otherwise(F.array().cast("array<string>")),
        "action": F.when(bad, "ask").otherwise(F.col("action")),
    }).drop("_flags")


# What the fields of a decision may hold, and what its consumer is asked to do for an action.
FIELD_VALUES = {"confidence": ("high", "medium", "low", "none"), "mode": ("review", "explain", "plan", "implement"), "action": ("dispatch", "ask", "handoff")}
NEEDED = ("candidates", "must_not", "reasons", "recipe")
NO_DOMAIN = ("mixed", "none")


def invalid_fields(domains: Sequence[str]) -> dict[str, Column]:
    """rule -> whether a decision breaks it: values out of their vocabulary, missing fields, and three rules across fields."""
    out = {name: ~F.col(name).isin(*values) for name, values in {"domain": (*domains, *NO_DOMAIN), **FIELD_VALUES}.items()}
    out |= {f"{name}_missing": F.col(name).isNull() for name in NEEDED}
    go = F.col("action") == "dispatch"
    return out | {
        "members_outside_candidates": F.size(F.array_except("members", "candidates")) > 0,
        "dispatch_without_target": go & (F.col("domain").isin(*NO_DOMAIN) | (F.col("recipe") == "") | (F.size("members") == 0)),
        "implement_forbids_changes": (F.col("mode") == "implement") & F.array_contains("must_not", "modify_files"),
    }


def adapt(decisions: DataFrame, domains: Sequence[str], forbidden: Forbidden = Forbidden()) -> DataFrame:
    """Consumer's view (id…, injected, load, prompt_action, forbidden), closed on any field that is invalid or can't be judged."""
    broken = F.lit(False)
    for rule in invalid_fields(domains).values():
        broken = broken | F.coalesce(rule, F.lit(True))
    out = decisions.withColumn("valid", ~broken)
    none, ok = F.array().cast("array<string>"), F.col("valid")
    prompts = {"handoff": F.lit("handoff"), "ask": F.lit("ask_clarification"), "dispatch": F.when(F.col("mode") == "explain", "overview_explain").otherwise(F.col("mode"))}
    prompt = F.lit("handoff")
    for action, then in prompts.items():
        prompt = F.when(ok & (F.col("action") == action), then).otherwise(prompt)
    unless = F.when(F.col("mode") != "implement", _strings(forbidden.unless_implement)).otherwise(none)
    return out.withColumns({
        "injected": F.when(ok, F.col("candidates")).otherwise(none), "load": F.when(ok & (F.col("action") == "dispatch"), F.col("members")).otherwise(none), "prompt_action": prompt,
        "forbidden": F.when(ok, ordered_union_of(F.col("must_not"), _strings(forbidden.always), unless)).otherwise(_strings([*forbidden.always, *forbidden.unless_implement])),
    })


def check_cases(decisions: DataFrame, cases: DataFrame, key: str = "id") -> DataFrame:
    """(id, fails, pass): domain, action, one of actionIn, all of skills, any of anySkills; absent ones aren't checked."""
    both = cases.select(key, "expect").join(decisions, key, "left")
    got = F.coalesce("candidates", F.array().cast("array<string>"))
    e = F.col("expect")
    listed = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    fails = F.array_compact(F.array(
        F.when(e["domain"].isNotNull() & ~F.coalesce(e["domain"] == F.col("domain"), F.lit(False)), "domain"),
        F.when(e["action"].isNotNull() & ~F.coalesce(e["action"] == F.col("action"), F.lit(False)), "action"),
        F.when(listed(e["actionIn"]) & ~F.coalesce(F.array_contains(e["actionIn"], F.col("action")), F.lit(False)), "actionIn"),
        F.when(listed(e["skills"]) & (F.size(F.array_except(e["skills"], got)) > 0), "skills"),
        F.when(listed(e["anySkills"]) & ~F.arrays_overlap(e["anySkills"], got), "anySkills"),
    ))
    return both.select(key, fails.alias("fails"), (F.size(fails) == 0).alias("pass"))


def dump_hits(decisions: DataFrame, cases: DataFrame, key: str = "id") -> DataFrame:
    """(id, hit_any, hit_all, abstain_ok): hits are null where nothing is wanted, abstain_ok where the case is in scope."""
    both = cases.select(key, "wanted", "oos").join(decisions.select(key, "candidates", "action"), key, "left")
    got = F.coalesce("candidates", F.array().cast("array<string>"))
    some = F.size("wanted") > 0
    return both.select(key, F.when(some, F.arrays_overlap("wanted", got)).alias("hit_any"), F.when(some, F.size(F.array_except("wanted", got)) == 0).alias("hit_all"), F.when(F.col("oos"), F.coalesce(F.col("action") == "handoff", F.lit(True))).alias("abstain_ok"))


def eval_threshold(scores: DataFrame, labels: DataFrame, tau: float, key: str = "qid", item: str = "item") -> DataFrame:
    """(qid, picked, hit_any, hit_all, abstain_ok) where every item with a score of tau or more is picked. labels: (qid, wanted, oos)."""
    picked = scores.filter(F.col("score") >= tau).groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("picked"))
    both = labels.join(picked, key, "left").withColumn("picked", F.coalesce("picked", F.array().cast(f"array<{dict(scores.dtypes)[item]}>")))
    some = F.size("wanted") > 0
    return both.select(key, "picked", F.when(some, F.arrays_overlap("wanted", "picked")).alias("hit_any"), F.when(some, F.size(F.array_except("wanted", "picked")) == 0).alias("hit_all"), F.when(F.col("oos"), F.size("picked") == 0).alias("abstain_ok"))


def eval_choice(scores: DataFrame, labels: DataFrame, key: str = "qid", item: str = "item", none: str = "NONE") -> DataFrame:
    """(qid, picked, top1_p, top3, hit, abstain_ok): the item of greatest score, where `none` stands for no item."""
    best = top_k(scores, [key], "score", 3, [item]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", item, "score"))).alias("_b"))
    both = labels.join(best, key, "left")
    top = F.get("_b", F.lit(0))
    rows = both.withColumns({"picked": F.when(top[item] != none, top[item]), "top1_p": top["score"], "top3": F.transform("_b", lambda x: x[item])})
    return rows.select(key, "picked", "top1_p", "top3", F.when(F.size("wanted") > 0, F.coalesce(F.array_contains("wanted", F.col("picked")), F.lit(False))).alias("hit"), F.when(F.col("oos"), F.col("picked").isNull()).alias("abstain_ok"))


def hybrid(first: DataFrame, second: DataFrame, labels: DataFrame, k: int = 8, tau: float = 0.5, key: str = "qid", item: str = "item") -> DataFrame:
    """(qid, short_n, rr_top1, rr_max, picked, rr_hit, hit): the k best by the first score, judged by the second; below tau none."""
    short = top_k(first, [key], "score", k, [item]).select(key, item)
    seconds = short.join(second.select(key, item, F.col("score").alias("s2")), [key, item], "left")
    first_of = top_k(seconds, [key], "s2", 1, [item]).select(key, F.when(F.col("s2").isNotNull(), F.col(item)).alias("rr_top1"))
    best = seconds.groupBy(key).agg(F.count("*").alias("short_n"), F.max("s2").alias("rr_max")).join(first_of, key)
    both = labels.join(best, key, "left").withColumn("picked", F.when(F.col("rr_max") >= tau, F.col("rr_top1")))
    some = F.size("wanted") > 0
    return both.select(key, "short_n", "rr_top1", "rr_max", "picked", F.when(some, F.coalesce(F.array_contains("wanted", F.col("rr_top1")), F.lit(False))).alias("rr_hit"), F.when(some, F.coalesce(F.array_contains("wanted", F.col("picked")), F.lit(False))).otherwise(F.col("picked").isNull()).alias("hit"))


def two_stage(scope: DataFrame, gates: DataFrame, members: DataFrame, items: DataFrame, labels: DataFrame, tau_scope: float, tau_gate: float, key: str = "qid", item: str = "item") -> DataFrame:
    """(qid, in_scope, doms, short_n, picked, hit): scope(qid, score), then gates(qid, domain, score), then the members of
    the domains that pass, of which the item of greatest score is picked."""
    inside = scope.filter(F.col("score") >= tau_scope).select(key)
    passed = gates.filter(F.col("score") >= tau_gate).join(inside, key, "left_semi").select(key, "domain")
    doms = passed.groupBy(key).agg(F.array_sort(F.collect_set("domain")).alias("doms"))
    short = passed.join(members, "domain").select(key, item).distinct().join(items, [key, item])
    best = top_k(short, [key], "score", 1, [item]).select(key, F.col(item).alias("picked"))
    out = labels.join(inside.withColumn("_in", F.lit(True)), key, "left").join(doms, key, "left").join(short.groupBy(key).agg(F.count("*").alias("short_n")), key, "left").join(best, key, "left")
    hit = F.when(F.size("wanted") > 0, F.coalesce(F.array_contains("wanted", F.col("picked")), F.lit(False))).otherwise(F.col("picked").isNull())
    return out.select(key, F.coalesce("_in", F.lit(False)).alias("in_scope"), "doms", F.coalesce("short_n", F.lit(0)).alias("short_n"), "picked", hit.alias("hit"))


def band_hits(rows: DataFrame, band: str = "band", score: str = "top1_score") -> DataFrame:
    """rows with band_hit: the score lies in [lo, hi]; null without a band."""
    return rows.withColumn("band_hit", F.when(F.col(band).isNotNull(), F.col(score).between(F.col(band)[0], F.col(band)[1])))


def disagreement(rows: DataFrame, score: str = "score", top: str = "top1", action: str = "action", dispatched: str = "dispatched") -> DataFrame:
    """rows with class, from a model's top name and score and a decision's action and names; the first that fits counts."""
    s, inside = F.col(score), F.coalesce(F.array_contains(dispatched, F.col(top)), F.lit(False))
    go = F.col(action) == "dispatch"
    kind = (
        F.when((s >= 0.5) & inside, "agree")
        .when(go & ~inside & (s >= 0.5), "model-diverges")
        .when(F.col(action).isin("ask", "handoff") & (s >= 0.5), "model-finds-gap")
        .when(go & (s < 0.05), "router-overfires")
        .when(s.between(0.05, 0.45), "gray")
        .when(inside, "agree")
        .otherwise("low-agree")
    )
    return rows.withColumn("class", kind)


def harvest(hints: DataFrame, known: Sequence[tuple[DataFrame, str]], existing: DataFrame, prefix: str = "b-", width: int = 3, text: str = "hint", order: Sequence[str] = ("ts",)) -> DataFrame:
    """New cases from missed hints: not known yet, the first of each normalised text, numbered on, tagged by language, with an empty expectation."""
    new = dedupe_first(fresh_only(hints, text, *known), norm_key(F.col(text)), order)
    return assign_ids(new, existing, "id", prefix, width, order).select("id", F.col(text).alias("query"), lang_tag(F.col(text)).alias("lang"), F.lit("").alias("expect"))


def term_precision(hits: DataFrame, classes: DataFrame, key: str = "doc") -> DataFrame:
    """(term, overfires, agrees): how often a term's rows are overfires or agreements."""
    return hits.join(classes, key).groupBy("term").agg(F.count_if(F.col("class") == "router-overfires").alias("overfires"), F.count_if(F.col("class") == "agree").alias("agrees"))

