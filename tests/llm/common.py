"""Rows that every operator must take, and small helpers."""

import random
import re

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = "row long, key string, fp string, component string, part string, rank string, length string, items string, spans string, score string, _label string, _id string, _keep string, kept string, n string, h string, w string, t string"


def docs(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """rows: (doc_id, text). extra: with columns of clashing names."""
    full = [(i, t, "en", "web", None if t is None else len(t)) for i, t in rows]
    if not extra:
        return spark.createDataFrame(full, DOCS)
    return spark.createDataFrame([(*r, *([k] + ["x"] * (CLASHING.count(",")))) for k, r in enumerate(full)], f"{DOCS}, {CLASHING}")


def invented(r: random.Random, n: int, words: int = 400) -> str:
    return " ".join("".join(r.choice("abcdeghilmnoprstu") for _ in range(2 + (k * 7 + words) % 6)) for k in (r.randrange(words) for _ in range(n)))


def edge_rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty and white texts, one word, repeated rows, a very long text, odd characters."""
    r = random.Random(seed)
    long = invented(r, 60_000)
    same = invented(r, 80)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, same), (5, same), (6, same), (None, same), (None, None), (7, long), (8, "zwölf Übungen  und \U0001f600 " + same), (9, "\x00a\x0bb\x1c"), (10, "x" * 50_000)]


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def alnum_words(s: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))


def words(s: str | None, fold: bool = True) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(s or "") if fold else s or "")


def key(row) -> tuple:
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: str(key(r)))
