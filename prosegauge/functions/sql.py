"""The library's functions for SQL: scalar functions and table functions over Markdown texts.

`register` adds them to a session. Scalar functions are SQL functions, so they stay in the plan; table functions give
the blocks, headings and links of a text for `LATERAL` joins.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from prosegauge.functions.text import RARE_WS, config_hash
from prosegauge.operators.markdown import structure


def _read(text: str | None) -> dict:
    return structure((text or "").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))


@udtf(returnType="line: int, text: string")
class Blocks:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from ((b["line"], b["text"].replace("\x04", "")) for b in _read(text)["blocks"])


@udtf(returnType="line: int, level: int, text: string")
class Headings:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from ((h["line"], h["level"], h["text"].replace("\x04", "")) for h in _read(text)["headings"])


@udtf(returnType="line: int, image: boolean, kind: string, label: string, target: string")
class Links:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from ((x["line"], x["image"], x["kind"], x["label"], x["target"]) for x in _read(text)["links"])


SCALARS = {
    "word_count(t STRING) RETURNS INT": rf"regexp_count(regexp_replace(coalesce(t, ''), r'{RARE_WS}', ' '), r'[^\t\n\x0B\f\r ]+')",
    "line_at(t STRING, at INT) RETURNS INT": "length(substring(t, 1, at)) - length(replace(substring(t, 1, at), '\n', '')) + 1",
    "table_cell(t STRING) RETURNS STRING": r"regexp_replace(replace(t, '|', '\\|'), '\r?\n', ' ')",
    "config_hash() RETURNS STRING": f"'{config_hash()}'",
}


def register(spark: SparkSession) -> None:
    for name, function in {"md_blocks": Blocks, "md_headings": Headings, "md_links": Links}.items():
        spark.udtf.register(name, function)
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
