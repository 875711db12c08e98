"""Detectors from outside: statistical models run in Arrow batches, loaded once per Python worker.

A plug-in is a function from a list of texts to a list, for each text, of (entity_type, start, end, confidence). None is
built in; the libraries for the usual ones are optional and imported on the workers when first used.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.model import ENTITIES

Model = Callable[[list[str]], list[list[tuple[str, int, int, float]]]]
SPACY_TYPES = {"PERSON": "PERSON", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION"}
SPACY_CONFIDENCE = 0.85


def detector(load: Callable[[], Model], source: str) -> Callable[[Column], Column]:
    """A detector from load(), which returns the model and runs once in a task."""
    item = pa.struct([("entity_type", pa.string()), ("original_text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("source", pa.string())])

    def run(batches):
        model = load()
        for batch in batches:
            texts = batch.to_pylist()
            found = iter(model([t for t in texts if t]))
            rows = [[{"entity_type": k, "original_text": t[a:b], "start": a, "end": b, "confidence": float(c), "source": source} for k, a, b, c in next(found)] if t else [] for t in texts]
            yield pa.array(rows, pa.list_(item))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, ENTITIES)
    return lambda text: F.coalesce(udf(text), F.array().cast(ENTITIES))


def spacy(model: str = "en_core_web_lg") -> Callable[[Column], Column]:
    """Named entities of a spaCy model; ORG becomes ORGANIZATION, GPE and LOC become LOCATION, others are dropped."""

    def load() -> Model:
        import spacy as library

        nlp = library.load(model)
        return lambda texts: [[(SPACY_TYPES[e.label_], e.start_char, e.end_char, SPACY_CONFIDENCE) for e in d.ents if e.label_ in SPACY_TYPES] for d in nlp.pipe(texts)]

    return detector(load, "spacy")


def presidio(language: str = "en") -> Callable[[Column], Column]:
    """All recognisers of Presidio's analyser, with their scores."""

    def load() -> Model:
        from presidio_analyzer import AnalyzerEngine

        engine = AnalyzerEngine()
        return lambda texts: [[(r.entity_type, r.start, r.end, r.score) for r in engine.analyze(text=t, language=language)] for t in texts]

    return detector(load, "presidio")
