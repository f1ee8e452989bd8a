"""Which engine finds person names, resolved once and passed along; no state is kept anywhere."""

from __future__ import annotations

import importlib.util
import platform
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial

from ..functions import checks

ENGINES = ("auto", "spacy", "regex")


#: Spans (start, end) of the persons in each of some texts, handled by so many at once.
Finder = Callable[[list[str], int], list[list[tuple[int, int]]]]


@dataclass(frozen=True)
class EngineConfig:
    """``load`` makes the model's finder where it is used, once in a worker's task; None where names are found by rules."""

    requested: str = "auto"
    engine: str = "regex"
    model: str | None = None
    load: Callable[[], Finder] | None = None


def spacy_finder(model: str) -> Finder:
    """Spans of the entities that a spaCy model calls persons."""
    import spacy

    nlp = spacy.load(model)
    return lambda texts, batch_size: [[(e.start_char, e.end_char) for e in d.ents if e.label_ == "PERSON"] for d in nlp.pipe(texts, batch_size=batch_size)]


def setup_engine(engine: str = "auto", model: str = "en_core_web_sm", load: Callable[[], Finder] | None = None) -> EngineConfig:
    """"regex" always works; "spacy" needs the library and its model; "auto" takes it where it's there. ``load`` gives a model
    of one's own, which is then the engine "model"."""
    checks.choice(engine, "engine", ENGINES)
    if load is not None:
        return EngineConfig(engine, "model", None, load)
    there = engine != "regex" and all(importlib.util.find_spec(m) for m in ("spacy", model))
    if engine == "spacy" and not there:
        raise RuntimeError(f"The library spacy and its model {model} are not installed.")
    return EngineConfig(engine, "spacy" if there else "regex", model if there else None, partial(spacy_finder, model) if there else None)


def check_engine(engine: str = "regex") -> dict[str, object]:
    """ready, engine, python, python_version, spacy_available, model_loaded, error."""
    config, error = None, None
    try:
        config = setup_engine(engine)
    except RuntimeError as e:
        error = str(e)
    return {"ready": config is not None, "engine": config.engine if config else None, "python": sys.executable, "python_version": platform.python_version(), "spacy_available": importlib.util.find_spec("spacy") is not None, "model_loaded": bool(config and config.model), "error": error}


def require_modules(names: Iterable[str]) -> dict[str, bool]:
    """Which modules can be imported here. Nothing is ever installed at run time."""
    return {n: importlib.util.find_spec(n) is not None for n in names}
