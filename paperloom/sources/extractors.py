"""Plug-in text extractors that feed the choice of the best candidate (X-01, X-02).

An extractor is a class of the user's with a name, a check whether it can be used, and a method for a bounded batch of files.
The files of a task come in Arrow batches; each document tries the extractors of its route in order until one gives text with
enough confidence, so costly ones later in the route see only what earlier ones could not read. Every try is a candidate row,
a failed one with its error: one unreadable file costs its own row, not the job.
"""
from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.operators.routing import best_candidate, route

# what runs in Python workers travels by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 16  # files that an extractor gets at once
CANDIDATE = (
    "processor string, priority int, raw_text string, confidence double, extraction_method string, page_count int, language string, "
    "entities map<string,string>, tables array<array<array<string>>>, error string"
)


@dataclass
class SourceFile:
    path: str
    doc_type: str | None
    content: bytes


@dataclass
class Extraction:
    """What an extractor read from one file."""

    raw_text: str = ""
    confidence: float = 0.0
    extraction_method: str = ""
    page_count: int = 0
    language: str = ""
    entities: dict[str, str] = field(default_factory=dict)
    tables: list[list[list[str]]] = field(default_factory=list)


class Extractor:
    """The contract. Instances travel to the workers, so they hold settings, not connections; open these in ``start``."""

    name = ""

    def available(self) -> bool:
        """Whether this extractor is configured; asked once per task, on the worker that would use it."""
        return True

    def start(self) -> None:
        """Called once per task before the first batch."""

    def process(self, file: SourceFile) -> Extraction:
        raise NotImplementedError

    def process_batch(self, files: list[SourceFile]) -> list[Extraction | Exception]:
        """One result or error per file, in order. Override it where files are cheaper together."""
        out: list[Extraction | Exception] = []
        for file in files:
            try:
                out.append(self.process(file))
            except Exception as error:  # noqa: BLE001  (an extractor may fail in any way; its error becomes a row)
                out.append(error)
        return out


class PlainText(Extractor):
    """Files that are text already. Text that holds markup is worth little as it is."""

    name = "plain_text"

    def process(self, file: SourceFile) -> Extraction:
        text = file.content.decode("utf-8")
        return Extraction(text, 0.3 if re.search(r"<[a-zA-Z/!]", text) else 0.9, "decoded", 1)


class Markup(Extractor):
    """Text between the tags of a marked-up file."""

    name = "markup"

    def process(self, file: SourceFile) -> Extraction:
        text = file.content.decode("utf-8", "replace")
        if not re.search(r"<[a-zA-Z/!]", text):
            raise ValueError("no markup")
        bare = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", text)))
        return Extraction(re.sub(r"[ \t\r\n\f\v]+", " ", bare).strip(" "), 0.8, "markup", 1)


def candidates(
    files: DataFrame, extractors: dict[str, Extractor], order: Column | None = None, min_confidence: float = rules.EXTRACTOR_ACCEPT, batch: int = BATCH
) -> DataFrame:
    """X-02's input: one row per try of an extractor. ``files``: doc_id, path, doc_type, content (bytes).

    ``extractors``: by the name under which a route mentions them; names without one are skipped, as are those that are not
    available. ``order``: the route, by default that of X-01. A result without text never ends the search.
    """
    order = route(F.col("doc_type"), F.col("path")) if order is None else order
    rows = files.select("doc_id", "path", "doc_type", "content", order.alias("_route"))
    kind = dict(files.dtypes)["doc_id"]
    names = [c.split(" ")[0] for c in CANDIDATE.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        usable: dict[str, bool] = {}

        def ready(name: str) -> bool:
            if name not in usable:
                usable[name] = name in extractors and bool(extractors[name].available())
                if usable[name]:
                    extractors[name].start()
            return usable[name]

        def judge(name: str, place: int, doc_id, result: Extraction | Exception) -> tuple:
            if isinstance(result, Exception):
                return (doc_id, name, place, "", 0.0, "", 0, "", {}, [], f"{type(result).__name__}: {result}")
            r = result
            return (doc_id, name, place, r.raw_text, float(r.confidence), r.extraction_method, r.page_count, r.language, r.entities, r.tables, None)

        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                open_rows = list(part.itertuples(index=False, name=None))
                out, place = [], 0
                while open_rows:
                    left, by_name = [], {}
                    for row in open_rows:
                        if row[4] is not None and place < len(row[4]):
                            (by_name.setdefault(row[4][place], []) if ready(row[4][place]) else left).append(row)
                    for name, own in by_name.items():
                        sources = [SourceFile(p or "", t, bytes(c) if c is not None else b"") for _, p, t, c, _ in own]
                        try:
                            results = extractors[name].process_batch(sources)
                            if len(results) != len(own):
                                raise ValueError(f"{len(results)} results for {len(own)} files")
                        except Exception as error:  # noqa: BLE001
                            results = [error] * len(own)
                        for row, result in zip(own, results):
                            out.append(judge(name, place, row[0], result))
                            good = not isinstance(result, Exception) and result.raw_text.strip() and result.confidence >= min_confidence
                            if not good:
                                left.append(row)
                    open_rows, place = left, place + 1
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", *names])

    return rows.mapInPandas(run, f"doc_id {kind}, {CANDIDATE}")


def extract_texts(files: DataFrame, extractors: dict[str, Extractor], order: Column | None = None, min_confidence: float = rules.EXTRACTOR_ACCEPT) -> DataFrame:
    """X-01 and X-02 over files: doc_id, processor, raw_text, confidence, outcome of every document."""
    return best_candidate(candidates(files, extractors, order, min_confidence), files, min_confidence)
