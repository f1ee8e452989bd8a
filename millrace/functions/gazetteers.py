"""Registers of places, facilities, schools and drugs that are no person's names.

The registers are inputs: ``Gazetteer.read`` takes a text file with a name a line. The package brings municipalities,
health facilities, and a few schools and drugs as examples; whoever has the full registers passes them in.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession

from .translit import ascii_text

TITLE = r"(?ai)^(?:Mr|Mrs|Ms|Miss|Dr|Doctor|RN|Paramedic|EMT)\.?\s+"


@lru_cache(maxsize=None)
def bundled(name: str) -> tuple[str, ...]:
    return tuple(x for x in (files("millrace") / "data" / name).read_text("utf-8").split("\n") if x.strip())


def normal(name: str, accents: bool) -> str:
    """Lower case, "&" as "and", anything but letters and digits as one blank."""
    name = (name if accents else ascii_text(name)).lower().replace("&", " and ")
    return re.sub("[^a-z0-9]+", " ", name).strip()


@lru_cache(maxsize=4)
def _whole(text: str, accents: bool) -> str:
    """The text's normal form; a text's candidates come one after the other."""
    return f" {normal(text, accents)} "


def fragments(name: str, most: int) -> list[str]:
    w = name.split(" ")
    return [" ".join(w[i : i + n]) for n in range(1, min(most, len(w)) + 1) for i in range(len(w) - n + 1)]


@dataclass
class Gazetteer:
    """Names, and for every run of up to ``most`` of their words the full names that have it.

    A candidate is a member if it is a full name, or a run of one that stands whole in the text around it.
    """

    names: Sequence[str]
    most: int = 3
    accents: bool = False
    title_counts: bool = False
    full: set[str] = field(init=False)
    index: dict[str, list[str]] = field(init=False)

    def __post_init__(self) -> None:
        self.full = {n for x in self.names if (n := normal(x, self.accents))}
        self.index = {}
        for n in sorted(self.full):
            for f in dict.fromkeys(fragments(n, self.most)):
                self.index.setdefault(f, []).append(n)

    @classmethod
    def read(cls, spark: SparkSession, path: str, **how) -> Gazetteer:
        """From a text file of one name a line. Registers of this kind are small, and are held on the driver."""
        return cls([r[0] for r in spark.read.text(path).filter("trim(value) != ''").distinct().collect()], **how)

    def has(self, candidate: str, text: str) -> bool:
        bare = normal(re.sub(TITLE, "", candidate), self.accents)
        if bare in self.full and not self.title_counts or normal(candidate, self.accents) in self.full and self.title_counts:
            return True
        found = self.index.get(bare)
        if not found:
            return False
        whole = _whole(text, self.accents)
        return any(f" {n} " in whole for n in found)


def municipality_aliases(names: Iterable[str]) -> list[str]:
    """Official names, their spoken order, their core, and an urban area with a common misspelling."""
    out = []
    for n in names:
        out.append(n)
        out.append(re.sub(r"^(.+), M\.D\. of$", r"Municipal District of \1", n))
        out.append(re.sub(r"^(.+), County of$", r"County of \1", n))
        out.append(re.sub(r"( No\. [0-9]+)?, (M\.D\.|County) of$", "", n))
    return list(dict.fromkeys([*out, "Fort McMurray", "Fort McMurry"]))


def normal_municipality(name: str) -> str:
    name = re.sub(r"(?a)\b0+([0-9]+)\b", r"\1", name.lower())
    name = re.sub("[^a-z0-9]+", " ", name).strip()
    return re.sub("^(?:city|town|village|summer village|municipality) of ", "", name)


@dataclass
class Municipalities:
    names: Sequence[str]

    def __post_init__(self) -> None:
        self.aliases = municipality_aliases(self.names)
        self.full = {normal_municipality(a) for a in self.aliases}
        self.parts = {f for n in self.full for f in fragments(n, 3)}

    def is_name(self, x: str) -> bool:
        return normal_municipality(x) in self.full

    def is_candidate(self, x: str) -> bool:
        """A run of up to three words of some name; no whole name needs to stand in the text."""
        return normal_municipality(re.sub(TITLE, "", x)) in self.parts


def municipalities(spark: SparkSession) -> DataFrame:
    """(category, name) of the 334 municipalities."""
    return spark.createDataFrame([tuple(reversed(x.split("\t"))) for x in bundled("municipalities.tsv")], "category string, name string")


def health_facilities(spark: SparkSession) -> DataFrame:
    """(category, name) of the health facilities; the category is the first letter, "0-9" or "Other"."""
    first = lambda x: x[0].upper() if re.match("[A-Za-z]", x) else "0-9" if re.match("[0-9]", x) else "Other"
    return spark.createDataFrame([(first(x), x) for x in bundled("health_facilities.txt")], "category string, name string")
