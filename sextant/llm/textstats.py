"""Statistics of a whole text, computed in one pass of byte-level operations.

A word is a maximal run of characters other than U+0020 and U+0009 to U+000D. ``bytes.split`` uses
exactly these six characters, so words are taken from the UTF-8 bytes. A null text has no words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import quoted
from sextant.session import spread

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
MARKS = b"!?"

#: name -> Arrow type; all counts are exact.
FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "n_lines": pa.int64(), "n_upper": pa.int64(), "n_lower": pa.int64(), "n_digits": pa.int64(), "n_marks": pa.int64(),
    "n_distinct_words": pa.int64(), "n_top_word": pa.int64(), "max_word_bytes": pa.int64(), "n_bytes": pa.int64(),
}
DDL = ", ".join(f"{name} long" for name in FIELDS)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    marked = np.zeros(len(words), dtype=bool)
    at = np.flatnonzero(np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows)))
    for shift in range(3):
        marked[at + shift] = True
    return int(marked.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics named in FIELDS, in that order."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    counts = Counter(words)
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        without(UPPER),
        without(LOWER),
        without(DIGITS),
        without(MARKS),
        len(counts),
        max(counts.values(), default=0),
        max(map(len, counts), default=0),
        len(raw),
    )


def stats_columns(texts: pa.ChunkedArray | pa.Array) -> list[pa.Array]:
    rows = [text_stats(t) for t in texts.to_pylist()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
    return [pa.array(values, kind) for values, kind in zip(columns, FIELDS.values(), strict=True)]


def with_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input without its text column, plus the statistics. Streams Arrow batches; no shuffle. Columns may have any name but those of ``FIELDS``."""
    kept = [f for f in df.schema.fields if f.name != text_col]
    plain = [f"k{i}" for i in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in plain] + stats_columns(batch.column("text")), names=plain + list(FIELDS))

    ddl = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(plain, kept, strict=True)] + [DDL])
    chosen = df.select(*[F.col(quoted(f.name)).alias(n) for f, n in zip(kept, plain, strict=True)], F.col(quoted(text_col)).alias("text"))
    return spread(chosen).mapInArrow(run, ddl).toDF(*[f.name for f in kept], *FIELDS)


def feature_matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Document statistics as bounded, comparable features, one row per document."""
    n = {k: np.asarray(v, dtype=float) for k, v in stats.items()}
    words, size = np.maximum(n["n_words"], 1), np.maximum(n["n_bytes"], 1)
    letters = np.maximum(n["n_upper"] + n["n_lower"], 1)
    return np.column_stack([
        np.log1p(n["n_words"]),
        n["word_chars"] / words,
        np.log1p(100 * n["n_symbols"] / words),
        n["n_dup_lines"] / np.maximum(n["n_lines"], 1),
        n["n_repeat_words"] / words,
        np.log1p(words / np.maximum(n["n_lines"], 1)),
        n["n_upper"] / letters,
        n["n_digits"] / size,
        np.log1p(100 * n["n_marks"] / words),
        n["n_distinct_words"] / words,
        n["n_top_word"] / words,
        np.log1p(n["max_word_bytes"]),
    ])
