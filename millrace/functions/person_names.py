"""Detection, masking and flagging of person names in free text, by rules and registers.

Finding names takes positions, lookahead into the text and repeated rescans, which Spark's expressions don't offer, so
texts pass an Arrow batch at a time through compiled patterns. Everything that a rule looks up is a parameter of
``Rules`` and travels with the task; there is no shuffle and no state between rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.engine import EngineConfig, Finder
from . import checks, known_names
from .gazetteers import Gazetteer, Municipalities, bundled

SENSITIVITIES = ("high_recall", "balanced", "high_precision")
CONFIDENCE = {"last_first": "high", "patient_abbreviation": "high", "titled_name": "high", "title_case_pair": "low", "workflow": "high"}
_EDGE = r"^[\p{P}\p{S}\s]+|[\p{P}\p{S}\s]+$"


def back(text: str, at: int, words: int) -> int:
    """Where the ``words`` blank-separated words before ``at`` begin."""
    for _ in range(words):
        while at and text[at - 1].isspace():
            at -= 1
        while at and not text[at - 1].isspace():
            at -= 1
    return at


def ahead(text: str, at: int, words: int) -> int:
    """Where the ``words`` words after ``at`` end."""
    for _ in range(words):
        while at < len(text) and text[at].isspace():
            at += 1
        while at < len(text) and not text[at].isspace():
            at += 1
    return at


def _any(words: Sequence[str]) -> str:
    return "(?i:" + "|".join(regex.escape(w).replace(r"\ ", r"\s+").replace(" ", r"\s+") for w in sorted(words, key=lambda w: -len(w))) + ")"


class Guided:
    """A pattern that is tried only where a cheap one, which any match of it begins with, finds a place."""

    def __init__(self, pattern: regex.Pattern, begin: str) -> None:
        self.pattern, self.begin = pattern, re.compile(begin, re.ASCII)

    def search(self, text: str, at: int = 0) -> regex.Match | None:
        return next((m for x in self.begin.finditer(text, at) if (m := self.pattern.match(text, x.start()))), None)

    def finditer(self, text: str) -> Iterator[regex.Match]:
        at = 0
        while m := self.search(text, at):
            yield m
            at = m.end()


def _default(name: str, **how) -> Gazetteer:
    return Gazetteer(bundled(name), **how)


@dataclass
class Rules:
    """Registers and word lists; ``default_rules`` has the bundled ones."""

    places: Sequence[str] = ()
    facilities: Gazetteer = field(default_factory=lambda: Gazetteer([]))
    schools: Gazetteer = field(default_factory=lambda: Gazetteer([]))
    drugs: Gazetteer = field(default_factory=lambda: Gazetteer([], most=4))
    clinical_terms: Sequence[str] = ()
    clinical_phrases: Sequence[str] = ()

    def engine(self) -> Engine:
        return Engine(self)


def default_rules(**changed) -> Rules:
    how = {
        "places": [x.split("\t")[0] for x in bundled("municipalities.tsv")],
        "facilities": _default("health_facilities.txt", accents=True),
        "schools": _default("schools.txt", title_counts=True),
        "drugs": _default("drugs.txt", most=4),
        "clinical_terms": bundled("clinical_terms.txt"),
        "clinical_phrases": bundled("clinical_phrases.txt"),
    }
    return Rules(**(how | changed))


class Engine:
    """Compiled patterns. Spans are (start, end), from 0, the end exclusive."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.places = Municipalities(rules.places)
        r = lambda p: regex.compile(p, regex.V0 | regex.ASCII)
        barred = f"(?:{_any(bundled('organization_words.txt'))}|{_any(bundled('location_words.txt'))})"
        title_case = r"(?:[A-Z][a-z]+(?:[A-Z][a-z]+)*(?:[-'][A-Z]?[a-z]+)*|[A-Z](?:['-][A-Z]?[a-z]+)+)"
        word = rf"(?!{barred}\b)(?:[A-Z]\.|{title_case}|[A-Z]{{2,}}(?:[-'][A-Z]+)*|[A-Z](?:['-][A-Z]+)+)"
        person = rf"(?!(?i:Pt)\b)(?!{barred}\b){title_case}"
        stop = rf"(?![A-Za-z'-])(?!\s+(?:{word}\s+){{0,2}}{barred}\b)"
        few = rf"{word}(?:\s+{word}){{0,2}}"
        alias = f"(?<![A-Za-z'-]){_any(self.places.aliases)}(?![A-Za-z'-])" if rules.places else "(?!)"
        guard = rf"(?!{alias}(?=\s*(?:$|[,.;:!?])))"
        title = r"\b(?:Mr|Mrs|Ms|Miss|Dr|Doctor|RN|Paramedic|EMT)\.?\s+"
        by = r"(?i:\b(?:reviewed|assessed|signed|completed|reported)\s+by\s+)\K"
        capital = "[A-Z](?<![A-Za-z0-9_][A-Z])"
        self.patterns = {
            "last_first": Guided(r(rf"\b{word}\s*,\s*{few}{stop}"), rf"{capital}(?=[A-Za-z'.-]*+\s*+,\s*+[A-Z])"),
            "patient_abbreviation": r(rf"(?i:\bPt\.?\s+)\K{few}{stop}"),
            "titled_name": r(rf"{title}{few}{stop}"),
            "title_case_pair": Guided(r(rf"\b{person}\s+(?:[A-Z]\.\s+)?{person}{stop}"), rf"{capital}(?=[A-Za-z'-]*+\s++[A-Z])"),
        }
        self.workflow = r(f"{by}{few}{stop}")
        self.passes = [self.patterns["last_first"], r(f"{title}{guard}{few}{stop}"), r(f"{by}{guard}{few}{stop}")]
        self.phrases = {self._phrase(p) for p in rules.clinical_phrases}
        self.phrase = r(f"(?<![A-Za-z'-]){_any(rules.clinical_phrases)}(?![A-Za-z'-])" if rules.clinical_phrases else "(?!)")
        runs = [max(re.findall("[a-z]+", p.lower()), key=len, default="") for p in rules.clinical_phrases]
        self.phrase_runs = list(dict.fromkeys(runs)) if all(runs) else [""]  # a text with a phrase has one of these in small letters
        clinical = _any(rules.clinical_terms) if rules.clinical_terms else "(?!)"
        nobody = f"(?:{barred}|{clinical})"
        self.inside, self.inside_clinical = r(rf"\b{nobody}\b"), r(rf"\b{clinical}\b")
        self.after, self.after_clinical = r(rf"\s+(?:{word}\s+){{0,2}}{nobody}\b"), r(rf"\s+(?:{word}\s+){{0,2}}{clinical}\b")
        provinces = _any(bundled("provinces.txt"))
        self.province_end, self.province = r(rf",\s*{provinces}\.?$"), r(rf"^{provinces}\.?$")
        verbs = r"spoke\s+(?:with|to)|talked\s+(?:with|to)|met|called|contacted|notified|(?:seen|assessed|reviewed|signed|completed|reported|accompanied|transported)\s+by"
        self.before_person = r(rf"(?i)(?:{verbs})\s+$")
        told = ["spoke", "called", "reported", "stated", "said", "advised", "arrived", "presented", "requested", "declined", "agreed", "reviewed", "assessed", "signed", "completed", "was", "is", "has", "had"]
        self.after_person = r(rf"(?i)^\s+(?:{'|'.join(told)})\b")

    def _phrase(self, x: str) -> str:
        return regex.sub(_EDGE, "", regex.sub(r"\s+", " ", x.strip())).lower()

    # what is no person

    def _geographic(self, candidate: str) -> bool:
        if self.province_end.search(candidate) or self.province.search(candidate.strip()):
            return True
        return "," in candidate and self.places.is_name(regex.sub(_EDGE, "", candidate.rsplit(",", 1)[1]))

    def _listed(self, candidate: str, text: str) -> bool:
        return self._geographic(candidate) or self.places.is_candidate(candidate) or any(g.has(candidate, text) for g in (self.rules.facilities, self.rules.schools, self.rules.drugs))

    def _clinical(self, text: str, start: int, end: int) -> bool:
        if self._phrase(text[start:end]) in self.phrases:
            return True
        around = self.phrase.finditer(text, back(text, start, 10), ahead(text, end, 10))  # phrases have fewer words
        return any(m.start() <= start and m.end() >= end for m in around)

    def nobody(self, text: str, start: int, end: int) -> bool:
        candidate = text[start:end]
        return bool(self._clinical(text, start, end) or self._listed(candidate, text) or self.inside.search(candidate) or self.after.match(text, end))

    def supported(self, text: str, start: int, end: int) -> bool:
        return bool(self.before_person.search(text[:start]) or self.after_person.search(text[end:]))

    # detection and masking

    def detect(self, text: str | None, sensitivity: str = "high_recall") -> list[tuple[int, int, str, str]]:
        """(start, end, name, rule) of non-overlapping names, the earliest and of those the longest first."""
        if not text or not text.strip():
            return []
        found = []
        for rule, pattern in self.patterns.items():
            for m in pattern.finditer(text):
                start, end = m.span()
                if rule == "title_case_pair" and (sensitivity == "high_precision" or sensitivity == "balanced" and not self.supported(text, start, end)):
                    continue
                start += len(m[0]) - len(m[0].lstrip())
                end = start + len(m[0].strip())
                if not self.nobody(text, start, end):
                    found.append((start, end, rule))
        kept: list[tuple[int, int, str, str]] = []
        for start, end, rule in sorted(found, key=lambda x: (x[0], -x[1])):
            if not kept or start >= kept[-1][1]:
                kept.append((start, end, text[start:end], rule))
        return kept

    def rules_mask(self, text: str | None, replacement: str) -> str | None:
        """The supplementary passes: comma names, titles, workflow phrases, each over the last one's result."""
        for pattern in self.passes:
            if not text or not text.strip():
                return text
            spans = [m.span() for m in pattern.finditer(text)]
            text = self._put(text, [s for s in spans if not self.nobody(text, *s)], replacement)
        return text

    @staticmethod
    def _put(text: str, spans: Sequence[tuple[int, int]], replacement: str) -> str:
        for start, end in sorted(spans, reverse=True):
            text = text[:start] + replacement + text[end:]
        return text

    def mask(self, text: str | None, replacement: str = "[NAME]", sensitivity: str = "high_recall", apply_rules: bool = True) -> str | None:
        if text is None:
            return None
        out = self._put(text, [x[:2] for x in self.detect(text, sensitivity)], replacement)
        return self.rules_mask(out, replacement) if apply_rules else out

    # flags

    def _without_phrases(self, text: str) -> str:
        small = text.lower()
        return self.phrase.sub(" | ", text) if any(x in small for x in self.phrase_runs) else text

    def _rest(self, text: str, seen: str, patterns: Sequence[regex.Pattern | Guided]) -> str | None:
        """None where there is a match that is a person. Those that aren't are blanked and the text is searched again."""
        for pattern in patterns:
            at = 0
            while m := pattern.search(seen, at):
                start, end = m.span()
                candidate = m[0]
                if not (self._listed(candidate, text) or self._clinical(seen, start, end) or self.inside_clinical.search(candidate) or self.after_clinical.match(seen, end)):
                    return None
                # a match and what it looks ahead to take fewer than ten words, so nothing before them changes
                at = back(seen, start, 12)
                seen = f"{seen[:start]} | {seen[end:]}"
        return seen

    def _supplementary(self, text: str) -> bool:
        return self._rest(text, self._without_phrases(text), [self.patterns["last_first"], self.workflow]) is None

    def flag(self, text: str | None, sensitivity: str = "high_recall", apply_rules: bool = True) -> int:
        if not text or not text.strip():
            return 0
        if sensitivity != "high_recall":
            return int(bool(self.detect(text, sensitivity)) or (apply_rules and self._supplementary(text)))
        # the supplementary rules begin with the first pattern too
        first, *others = self.patterns.values()
        seen = self._rest(text, self._without_phrases(text), [first])
        return int(seen is None or self._rest(text, seen, others) is None or (apply_rules and self._rest(text, seen, [self.workflow]) is None))

    def model_spans(self, text: str, spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
        """A model's spans but those of no person."""
        return [s for s in spans if not self.nobody(text, *s)]

    def mask_found(self, text: str, spans: Sequence[tuple[int, int]], replacement: str, apply_rules: bool) -> str:
        out = self._put(text, self.model_spans(text, spans), replacement)
        return self.rules_mask(out, replacement) if apply_rules else out

    def flag_found(self, text: str, spans: Sequence[tuple[int, int]], apply_rules: bool) -> int:
        return int(bool(self.model_spans(text, spans)) or (apply_rules and self._supplementary(text)))

    def detect_found(self, text: str, spans: Sequence[tuple[int, int]], sensitivity: str) -> list[tuple[int, int, str, str]]:
        """A model's names, and those of the rules that hold a comma; of overlapping ones the first, then the longest."""
        both = [(s, e, text[s:e], "model_person") for s, e in self.model_spans(text, spans)] + [x for x in self.detect(text, sensitivity) if "," in x[2]]
        kept: list[tuple[int, int, str, str]] = []
        for x in sorted(both, key=lambda x: (x[0], -x[1])):
            if not kept or x[0] >= kept[-1][1]:
                kept.append(x)
        return kept


@lru_cache(maxsize=4)
def _engine_of(key: bytes) -> Engine:
    """A worker's engine: its patterns are compiled once and kept between tasks."""
    return pickle.loads(key).engine()


@lru_cache(maxsize=2)
def _finder_of(key: bytes) -> Finder:
    return cloudpickle.loads(key)()


def _finding(engine: EngineConfig | None, batch_size: int) -> Callable[[list[str]], list] | None:
    """For tasks: a model's spans of some texts; None where the rules find names."""
    checks.whole(batch_size, "batch_size", 1)
    if engine is None or engine.load is None:
        return None
    load = cloudpickle.dumps(engine.load)
    return lambda texts: _finder_of(load)(texts, batch_size)


def _mapped(df: DataFrame, text: str, rules: Rules | None, name: str, kind: str, call, found=None, finding=None) -> DataFrame:
    """``df`` with a column made from ``text`` by the engine, batch by batch, equal texts of a batch once. With ``finding`` a
    model's spans of the texts that aren't blank go to ``found``."""
    checks.frame(df, "data")
    checks.column(df, text, "text")
    if not isinstance(df.schema[text].dataType, T.StringType):
        raise TypeError("`text` must be a text column.")
    rules = rules or default_rules()
    kept = [c for c in df.columns if c != name]
    at = kept.index(text) if text in kept else -1
    source = df.select(*[checks.q(c) for c in kept], *([checks.q(text).alias(name)] if at < 0 else []))
    at = at if at >= 0 else len(kept)
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(name, T._parse_datatype_string(kind))])
    type_ = pa.string() if kind == "string" else pa.int32()

    key = pickle.dumps(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine_of(key)
        for b in batches:
            done: dict = {}
            if finding:
                texts = [t for t in dict.fromkeys(b.column(at).to_pylist()) if t and t.strip()]
                done = {t: found(engine, t, spans) for t, spans in zip(texts, finding(texts))}
            values = [done[t] if t in done else done.setdefault(t, call(engine, t)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(values, type_)], names=[*kept, name])

    return source.mapInArrow(run, schema)


def _options(sensitivity: str, apply_rules: bool, replacement: str = "") -> None:
    checks.choice(sensitivity, "sensitivity", SENSITIVITIES)
    checks.flag(apply_rules, "apply_rules")
    if not isinstance(replacement, str):
        raise ValueError("`replacement` must be one non-missing character value.")


def mask_person_names(df: DataFrame, text: str, *, replacement: str = "[NAME]", sensitivity: str = "high_recall", apply_rules: bool = True, name_columns: Sequence[str] | None = None, rules: Rules | None = None, output: str = "masked_text", engine: EngineConfig | None = None, batch_size: int = 100, keep_original: bool = True) -> DataFrame:
    """``df`` with ``output``: names replaced. Names of the row's ``name_columns`` go first, whatever the registers say.

    ``engine`` (see ``setup_engine``) with a model takes names from it, ``batch_size`` texts at once, and from the rules' supplementary
    passes; without one the rules find them. Without ``keep_original`` the masked text takes the place of ``text``.
    """
    _options(sensitivity, apply_rules, replacement)
    if not checks.flag(keep_original, "keep_original"):
        out = mask_person_names(df, text, replacement=replacement, sensitivity=sensitivity, apply_rules=apply_rules, name_columns=name_columns, rules=rules, output=output, engine=engine, batch_size=batch_size)
        return out.select(*[checks.q(output).alias(c) if c == text else checks.q(c) for c in df.columns if c != output or c == text])
    finding = _finding(engine, batch_size)
    call, found = lambda e, t: e.mask(t, replacement, sensitivity, apply_rules), lambda e, t, s: e.mask_found(t, s, replacement, apply_rules)
    source, read = df, text
    if name_columns:
        names = known_names._checked(df, text, name_columns)
        source, read = df.withColumn(output, known_names.exact_mask(checks.q(text), names, replacement)), output
        known = "__known"
        while known in df.columns:
            known += "_"
        kept = source.withColumnRenamed(output, known)
        return _mapped(kept, known, rules, output, "string", call, found, finding).drop(known)
    return _mapped(source, read, rules, output, "string", call, found, finding)


def flag_person_names(df: DataFrame, text: str, *, sensitivity: str = "high_recall", apply_rules: bool = True, name_columns: Sequence[str] | None = None, rules: Rules | None = None, output: str = "name_flag", engine: EngineConfig | None = None, batch_size: int = 100) -> DataFrame:
    """``df`` with ``output``: 1 where the text names a person, else 0. It screens by its own algorithm, not by masking.
    ``engine`` and ``batch_size`` as for masking."""
    _options(sensitivity, apply_rules)
    out = _mapped(df, text, rules, output, "int", lambda e, t: e.flag(t, sensitivity, apply_rules), lambda e, t, s: e.flag_found(t, s, apply_rules), _finding(engine, batch_size))
    if name_columns:
        out = out.withColumn(output, F.greatest(output, known_names.exact_flag(checks.q(text), known_names._checked(df, text, name_columns))))
    return out


def apply_name_rules(df: DataFrame, text: str, *, replacement: str = "[NAME]", rules: Rules | None = None, output: str = "masked_text") -> DataFrame:
    """``df`` with ``output``: the supplementary passes alone."""
    _options("high_recall", True, replacement)
    return _mapped(df, text, rules, output, "string", lambda e, t: e.rules_mask(t, replacement))


def detect_person_names(df: DataFrame, text: str, row_id: str, *, sensitivity: str = "high_recall", explain: bool = False, rules: Rules | None = None, engine: EngineConfig | None = None, batch_size: int = 100) -> DataFrame:
    """(row_id, detected_name, start, end): a row for each name, places from 1, the end inclusive; with ``explain`` also
    rule and confidence. With a model in ``engine`` its names, and the rules' that hold a comma."""
    _options(sensitivity, True)
    checks.column(df, text, "text")
    checks.column(df, row_id, "row_id")
    rules = rules or default_rules()
    kind = df.schema[row_id].dataType
    fields = [T.StructField("row_id", kind), T.StructField("detected_name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("rule", T.StringType()), T.StructField("confidence", T.StringType())]

    key, finding = pickle.dumps(rules), _finding(engine, batch_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rules = _engine_of(key)
        for b in batches:
            at, rows = [], []
            texts = b.column(1).to_pylist()
            some = [t for t in dict.fromkeys(texts) if t and t.strip()] if finding else []
            spans = dict(zip(some, finding(some))) if finding else {}
            for i, t in enumerate(texts):
                for start, end, name, rule in by_rules.detect_found(t, spans[t], sensitivity) if t in spans else [] if finding else by_rules.detect(t, sensitivity):
                    at.append(i)
                    rows.append((name, start + 1, end, rule, CONFIDENCE.get(rule, "model")))
            cols = list(zip(*rows)) if rows else [()] * 5
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types)]], names=[f.name for f in fields])

    out = df.select(checks.q(row_id).alias("row_id"), checks.q(text).alias("t")).mapInArrow(run, T.StructType(fields))
    return out if explain else out.drop("rule", "confidence")
