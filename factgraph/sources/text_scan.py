"""Text search over live source, with budgets, and line and column of each match."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREVIEW_BYTES = 200


def scan(files: DataFrame, pattern: str, literal: bool = True, ignore_case: bool = False, max_bytes: int = 1 << 20) -> DataFrame:
    """Matches in (path_key, content binary): path_key, start_byte, end_byte, line, column, preview.

    Files with a NUL byte, not UTF-8, or over ``max_bytes`` are skipped.  Lines count from 0, columns in
    bytes.  Patterns are those of a linear-time engine: look-around and back-references are refused.
    """
    source = re.escape(pattern) if literal else pattern
    if not literal and re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    wanted = re.compile(source.encode(), (re.I if ignore_case else 0) | re.M)
    schema = "path_key string, start_byte long, end_byte long, line long, column long, preview string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, raw in zip(batch.column("path_key").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if raw is None or len(raw) > max_bytes or b"\0" in raw:
                    continue
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    continue
                line = at = 0
                for m in wanted.finditer(raw):
                    line += raw.count(b"\n", at, m.start())
                    at = m.start()
                    begin = raw.rfind(b"\n", 0, at) + 1
                    stop = raw.find(b"\n", at)
                    text = raw[begin : stop if stop >= 0 else len(raw)][:PREVIEW_BYTES].decode("utf-8", "ignore")
                    rows.append((path, at, m.end(), line, at - begin, text))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, [pa.string(), *[pa.int64()] * 4, pa.string()], strict=True)], ["path_key", "start_byte", "end_byte", "line", "column", "preview"])

    return files.select("path_key", "content").mapInArrow(run, schema)


def status(truncated: bool, found: int, unavailable: int, oversize: int) -> str:
    """What a search may claim, in order of precedence."""
    if truncated:
        return "TRUNCATED"
    if found:
        return "FOUND"
    if unavailable:
        return "UNAVAILABLE"
    return "TRUNCATED" if oversize else "NOT_FOUND"


def verified_range(sources: DataFrame, spans: DataFrame) -> DataFrame:
    """Bytes [start, end) of files whose content still has the hash that was recorded for it."""
    j = sources.join(spans, "path_key")
    ok = F.sha2("content", 256) == F.col("expected")
    return j.select("path_key", "start", "end", F.when(ok, F.substr("content", F.col("start") + 1, F.col("end") - F.col("start"))).alias("bytes"), ok.alias("verified"))
