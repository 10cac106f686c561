"""Document classes: a spec tree becomes one expression a row; no joins, no Python at run time.

A class is a mapping with

- class: its name; the first class that fits a path takes it
- match: a tree. path and name (of the last segment) are globs that all have to fit, exactPath is a list of paths of which one has to be it,
  notPath are globs of which none may fit, any is a list of trees of which one has to fit. All keys of a tree have to hold, and one of
  them at least has to be there beside notPath.
- header: off (default), warn or error, where a document has no header (fields are null; an empty header is one)
- required: names that must be there and not empty
- freshness: {anyOf: names of which one must be there, level}
- states: {field, vocab, tolerate}; a field that is there, also if it is empty, has to be in one of the lists
- fields: name -> {vocab, tolerate, pattern (found anywhere), equalsFilenameStem}; a field that isn't there is in order
- conditional: list of {when: name -> value or {notIn: values}, all of which hold; require: names that must then be there and not
  empty; check: name -> {lt-date: 'today' or a date}, which a day in that field may not lie before; level; msg, with {field} and
  {when.name} filled in}. It isn't judged where a field of `when` has failed its vocabulary or states.

Names with dots are keys of the fields' map like any other, so that nested headers are flattened by whoever reads them. Levels are error
(default) and warn. An unknown key anywhere in a spec is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import basename, glob_match

# The keys of a spec.
KEYS = {
    "class": {"class", "match", "header", "required", "freshness", "states", "fields", "conditional"},
    "match": {"path", "name", "exactPath", "notPath", "any"},
    "freshness": {"anyOf", "level"},
    "states": {"field", "vocab", "tolerate"},
    "field": {"vocab", "tolerate", "pattern", "equalsFilenameStem"},
    "conditional": {"when", "require", "check", "level", "msg"},
}
DAY = r"^\d{4}-\d{2}-\d{2}\z"


def _known(kind: str, spec: Mapping, where: str) -> Mapping:
    if not isinstance(spec, Mapping):
        raise ValueError(f"{where}: not a mapping")
    if unknown := set(spec) - KEYS[kind]:
        raise ValueError(f"{where}: unknown keys {sorted(unknown)}")
    return spec


def _list(value) -> list:
    return [] if value is None else [value] if isinstance(value, (str, Mapping)) else list(value)


def _every(tests) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _some(tests) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def fits(tree: Mapping, path: Column, where: str = "match") -> Column:
    """Whether a path fits a match tree."""
    _known("match", tree, where)
    if not set(tree) - {"notPath"}:
        raise ValueError(f"{where}: a match needs path, name, exactPath or any")
    globs = lambda key, of: [glob_match(of, g) for g in _list(tree.get(key))]
    tests = [*globs("path", path), *globs("name", basename(path)), *(~x for x in globs("notPath", path))]
    if "exactPath" in tree:
        tests.append(path.isin(*_list(tree["exactPath"])))
    if "any" in tree:
        tests.append(_some(fits(sub, path, f"{where}.any") for sub in _list(tree["any"])))
    return _every(tests)


def class_of(path: Column, classes: Sequence[Mapping]) -> Column:
    """Name of the first class whose match fits; null if none does."""
    out = F.lit(None).cast("string")
    for c in reversed(classes):
        out = F.when(fits(_known("class", c, f"class {c.get('class')}")["match"], path, f"class {c['class']}"), F.lit(c["class"])).otherwise(out)
    return out


def classify_docs(df: DataFrame, classes: Sequence[Mapping], path: str = "rel") -> DataFrame:
    """df with its class."""
    return df.withColumn("class", class_of(F.col(path), classes))


class _Judge:
    """Findings of one class, as columns that are null where all is well."""

    def __init__(self, spec: Mapping, path: Column, fields: Column, today: Column):
        self.spec, self.fields, self.today = _known("class", spec, f"class {spec.get('class')}"), fields, today
        self.stem = F.regexp_replace(basename(path), r"\.[^.]+\z", "")
        self.found: list[Column] = []
        self.failed: dict[str, Column] = {}  # field -> whether it isn't of its vocabulary or states
        self.header(), self.required(), self.freshness(), self.states(), self.values(), self.conditions()

    def value(self, name: str) -> Column:
        return self.fields[name]

    def empty(self, name: str) -> Column:
        return F.coalesce(self.value(name) == "", F.lit(True))

    def add(self, test: Column, rule: str, level: str | None, field: str, message: Column | str) -> None:
        level = level or "error"
        if level not in ("error", "warn"):
            raise ValueError(f"no such level: {level}")
        observed = self.value(field) if field else F.lit(None).cast("string")
        message = F.lit(message) if isinstance(message, str) else message
        self.found.append(F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.lit(field).alias("field"), observed.alias("observed"), message.alias("message"))))

    def header(self) -> None:
        if (level := self.spec.get("header", "off")) != "off":
            self.add(self.fields.isNull(), "header", level, "", "no header")

    def required(self) -> None:
        for name in _list(self.spec.get("required")):
            self.add(self.empty(name), "required", None, name, "missing or empty")

    def freshness(self) -> None:
        if spec := self.spec.get("freshness"):
            names = _list(_known("freshness", spec, "freshness")["anyOf"])
            self.add(_every(self.value(n).isNull() for n in names), "freshness", spec.get("level"), "", f"none of {', '.join(names)}")

    def _outside(self, name: str, spec: Mapping) -> Column:
        test = self.value(name).isNotNull() & ~self.value(name).isin(*_list(spec["vocab"]), *_list(spec.get("tolerate")))
        self.failed[name] = self.failed.get(name, F.lit(False)) | test
        return test

    def states(self) -> None:
        if spec := self.spec.get("states"):
            _known("states", spec, "states")
            self.add(self._outside(spec["field"], spec), "states", None, spec["field"], "not a state")

    def values(self) -> None:
        for name, spec in self.spec.get("fields", {}).items():
            _known("field", spec, f"fields.{name}")
            there = self.value(name).isNotNull()
            if "vocab" in spec:
                self.add(self._outside(name, spec), "vocab", None, name, "not in the vocabulary")
            if "pattern" in spec:
                self.add(there & ~self.value(name).rlike(spec["pattern"]), "pattern", None, name, f"doesn't fit {spec['pattern']}")
            if spec.get("equalsFilenameStem"):
                self.add(there & (self.value(name) != self.stem), "stem", None, name, "isn't the name of the file")

    def conditions(self) -> None:
        for spec in _list(self.spec.get("conditional")):
            when = _known("conditional", spec, "conditional")["when"]
            holds = _every([*(self._holds(n, want) for n, want in when.items()), *(~self.failed[n] for n in when if n in self.failed)])
            for name in _list(spec.get("require")):
                self.add(holds & self.empty(name), "conditional", spec.get("level"), name, self._message(spec, name, f"needs {name}"))
            for name, bound in spec.get("check", {}).items():
                if set(bound) != {"lt-date"}:
                    raise ValueError(f"conditional.check.{name}: no such check: {sorted(bound)}")
                day = F.date_format(self.today, "yyyy-MM-dd") if bound["lt-date"] == "today" else F.lit(bound["lt-date"])
                late = F.coalesce(self.value(name).rlike(DAY) & (self.value(name) < day), F.lit(False))
                self.add(holds & late, "conditional-check", spec.get("level"), name, self._message(spec, name, f"{name} is over"))

    def _holds(self, name: str, want) -> Column:
        if isinstance(want, Mapping):
            if set(want) != {"notIn"}:
                raise ValueError(f"when.{name}: no such condition: {sorted(want)}")
            return self.value(name).isNotNull() & ~self.value(name).isin(*_list(want["notIn"]))
        return self.value(name).eqNullSafe(F.lit(want))

    def _message(self, spec: Mapping, name: str, otherwise: str) -> Column:
        filled = {"{field}": lambda _: F.lit(name)}
        shown: Callable[[str], Column] = lambda mark: filled[mark](mark) if mark in filled else F.coalesce(self.value(mark[6:-1]), F.lit(""))
        parts = re.split(r"(\{field\}|\{when\.\w+\})", spec.get("msg", otherwise))
        return F.concat(*(shown(p) if p.startswith(("{field}", "{when.")) else F.lit(p) for p in parts))


def docclass_findings(df: DataFrame, classes: Sequence[Mapping], today: Column, path: str = "rel", fields: str = "fields") -> DataFrame:
    """(rel, class, rule, level, field, observed, message) from documents (rel, fields: map<string,string>, null without a header).

    Rules: header, required, freshness, states, vocab, pattern, stem, conditional, conditional-check. Documents of no class have none.
    """
    found = F.array().cast("array<struct<rule:string,level:string,field:string,observed:string,message:string>>")
    for c in reversed(classes):
        own = _Judge(c, F.col(path), F.col(fields), today).found
        found = F.when(F.col("class") == c["class"], F.array_compact(F.array(*own)) if own else F.array().cast("array<struct<rule:string,level:string,field:string,observed:string,message:string>>")).otherwise(found)
    return classify_docs(df, classes, path).filter("class IS NOT NULL").select(path, "class", F.explode(found).alias("f")).select(path, "class", "f.*")


def docclass_counts(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, classified, unclassified."""
    a = findings.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"))
    return a.join(docs.agg(F.count("class").alias("classified"), F.count_if(F.col("class").isNull()).alias("unclassified")))
