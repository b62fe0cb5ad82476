"""Files that Spark has no reader for, and lists of files. These run on the driver: they are for small side
inputs (maps, caches, configurations), which become DataFrames here."""

from __future__ import annotations

import io
import json
import os
import pickle
import urllib.parse
import urllib.request
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class _Plain(pickle.Unpickler):
    """Loads containers, strings and numbers; everything else in a pickle is refused, as it could run code."""

    def find_class(self, module, name):
        if module in ("builtins", "__builtin__") and name in ("set", "frozenset", "dict", "list", "tuple"):
            return {"set": set, "frozenset": frozenset, "dict": dict, "list": list, "tuple": tuple}[name]
        raise pickle.UnpicklingError(f"{module}.{name} is not a plain value")


def read_term_map(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(symbol, term) from a pickled map of symbols to sets of terms: symbols in upper case, terms of the
    prefix alone. An empty map gives an empty table."""
    with open(path, "rb") as f:
        found = _Plain(io.BytesIO(f.read())).load()
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no map")
    rows = [(str(k).upper(), str(t)) for k, terms in found.items() for t in sorted(map(str, terms)) if str(t).startswith(prefix)]
    return spark.createDataFrame(rows, "symbol string, term string").distinct()


def fetched(url: str, cache: str, form: Mapping[str, str] | None = None, timeout: float = 60.0) -> str:
    """The text behind a url, posted with a form if there is one; from the cache file where there is one. A
    download is written under another name first, so that a broken one leaves no cache."""
    if os.path.exists(cache):
        with open(cache, encoding="utf-8") as f:
            return f.read()
    data = urllib.parse.urlencode(form).encode() if form else None
    with urllib.request.urlopen(urllib.request.Request(url, data=data), timeout=timeout) as answer:
        text = answer.read().decode("utf-8")
    os.makedirs(os.path.dirname(os.path.abspath(cache)), exist_ok=True)
    with open(f"{cache}.part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{cache}.part", cache)
    return text


def association_scores(spark: SparkSession, text: str, source: str = "preferredName_A", target: str = "preferredName_B", score: str = "score") -> DataFrame:
    """(source, target, score) from tab-separated text with a header: upper-case symbols, the largest score of
    a pair, from 0 to 1, both ways. Rows without a number are left out."""
    lines = [x.split("\t") for x in text.splitlines() if x.strip()]
    if not lines:
        return spark.createDataFrame([], "source string, target string, score double")
    at = [lines[0].index(c) for c in (source, target, score)]
    raw = spark.createDataFrame([tuple(x[i] if i < len(x) else None for i in at) for x in lines[1:]], "a string, b string, s string")
    rows = raw.select(F.upper("a").alias("a"), F.upper("b").alias("b"), F.expr("try_cast(s AS double)").alias("s")).where("s is not null and a <> b")
    both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    return both.groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("s"))).alias("score"))


def read_cells(spark: SparkSession, path: str, genes: Sequence[str] | None = None) -> DataFrame:
    """(cell, gene, value) of an h5ad file's matrix, zeros left out; needs h5py."""
    import h5py

    with h5py.File(path, "r") as f:
        names = [x.decode() if isinstance(x, bytes) else str(x) for x in f["var"][f["var"].attrs.get("_index", "_index")][:]]
        x = f["X"]
        if isinstance(x, h5py.Group):
            starts, columns, values = (x[k][:] for k in ("indptr", "indices", "data"))
            rows = [(i, names[columns[k]].upper(), float(values[k])) for i in range(len(starts) - 1) for k in range(starts[i], starts[i + 1])]
        else:
            rows = [(i, names[j].upper(), float(v)) for i, row in enumerate(x[:]) for j, v in enumerate(row) if v]
    df = spark.createDataFrame(rows, "cell int, gene string, value double")
    return df.where(F.col("gene").isin([g.upper() for g in genes])) if genes is not None else df


def write_bars(df: DataFrame, path: str, label: str, value: str) -> None:
    """A bar for each row of a small table as an image; needs matplotlib."""
    import matplotlib.pyplot as plt

    rows = df.select(label, value).collect()
    fig, ax = plt.subplots()
    ax.bar([str(r[0]) for r in rows], [r[1] for r in rows])
    ax.set_ylabel(value)
    fig.savefig(path, bbox_inches="tight")
    plt.close(fig)


def is_system_file(name: str) -> bool:
    """Names that another system's file manager leaves beside files."""
    return os.path.basename(name).startswith("._")


def relative_files(folder: str) -> list[str]:
    """Paths of the files below a folder, relative to it and in order, without those of file managers."""
    found = [os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names]
    return sorted(x for x in found if not is_system_file(x))


def read_config(path: str | None, given: Mapping[str, object], defaults: Mapping[str, object]) -> dict[str, object]:
    """Settings: defaults, then those of a JSON file, then the given ones that aren't None. Unknown names are errors."""
    told = {}
    if path:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
    if unknown := sorted((set(told) | set(given)) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return dict(defaults) | told | {k: v for k, v in given.items() if v is not None}
