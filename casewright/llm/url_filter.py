"""URL rules looked up in a Bloom filter cascade: exact for every key of the corpus, without a join."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import mix
from casewright.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LISTED = 5_000_000  # listed keys that one cascade takes: its levels are kept by every worker


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with its subdomains and all paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Bloom:
    """Bits and number of probes; ``salt`` makes the filters of a cascade independent."""

    bits: np.ndarray
    probes: int
    salt: int

    @staticmethod
    def of(keys: np.ndarray, rate: float, salt: int) -> Bloom:
        size = max(64, math.ceil(len(keys) * math.log2(1 / rate) / math.log(2) / 64) * 64)
        made = Bloom(np.zeros(size, dtype=bool), max(1, round(math.log2(1 / rate))), salt)
        for places in made._places(keys):
            made.bits[places] = True
        return made

    def _places(self, keys: np.ndarray) -> Iterable[np.ndarray]:
        with np.errstate(over="ignore"):
            first = mix(keys[:, 0] + np.uint64(2 * self.salt + 1) * np.uint64(0x9E3779B97F4A7C15))
            step = mix(keys[:, 1] ^ first) | np.uint64(1)
            for n in range(self.probes):
                yield (first + np.uint64(n) * step) % np.uint64(len(self.bits))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for places in self._places(keys):
            found &= self.bits[places]
        return found


@dataclass(frozen=True)
class Cascade:
    """Level 0 holds the listed keys, each further level the keys that the level before took wrongly."""

    levels: tuple[Bloom, ...]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is listed; right for every listed key and every key of the universe."""
        answer, open_ = np.zeros(len(keys), dtype=bool), np.arange(len(keys))
        for depth, level in enumerate(self.levels):
            inside = level.holds(keys[open_])
            answer[open_[~inside]] = depth % 2 == 1
            open_ = open_[inside]
        answer[open_] = len(self.levels) % 2 == 1
        return answer


def key_hashes(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def _pairs(a, b) -> np.ndarray:
    return np.stack([np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)], axis=1).view(np.uint64).reshape(-1, 2)


def build_cascade(listed: Sequence[str], universe: DataFrame) -> Cascade:
    """The cascade for ``listed`` over the distinct key hashes ``a, b`` of ``universe``.

    The first rate is r / (s * sqrt 2) for r listed and s other keys, the others are one half: the levels then hold
    about r * log2(s / r) bits in all. Only keys that level 0 takes come to the driver, r and about r / sqrt 2 more.
    An empty list holds nothing.
    """
    if len(listed) > MAX_LISTED:
        raise ValueError(f"{len(listed)} keys are listed; a cascade takes {MAX_LISTED}")
    if not listed:
        return Cascade(())
    spark = universe.sparkSession
    own = spark.createDataFrame([(k,) for k in dict.fromkeys(listed)], "key string").select(key_hashes(F.col("key")).alias("h"))
    own = own.select("h.a", "h.b").toPandas()
    keys = _pairs(own["a"], own["b"])
    others = universe.count()
    levels = [Bloom.of(keys, min(0.5, len(keys) / max(1, others) / math.sqrt(2)), 0)]

    first = levels[0]

    @F.pandas_udf("boolean")
    def taken(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(first.holds(_pairs(a, b)))

    hits = universe.filter(taken("a", "b")).toPandas()
    mine = {tuple(k) for k in keys.tolist()}
    wrong = [k for k in _pairs(hits["a"], hits["b"]).tolist() if tuple(k) not in mine]
    inside, outside = keys, np.array(wrong, dtype=np.uint64).reshape(-1, 2)
    while len(outside):
        levels.append(Bloom.of(outside, 0.5, len(levels)))
        inside, outside = outside, inside[levels[-1].holds(inside)]
    return Cascade(tuple(levels))


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    column = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    cut = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(column, cut, 1), UPPER, LOWER), F.regexp_extract(column, cut, 2)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", unlisted: str = "allow") -> DataFrame:
    """Adds ``host, path, rule, verdict`` to the pages.

    A page's keys are its host and parent hosts, as many labels as rules have, each with the beginnings of its path
    that are as long as paths of rules. One cascade for each verdict says which keys are listed; of the listed keys
    the longest (then the one with the longer host) is the rule. A page without one is ``unlisted``: the cascade is
    exact, so nothing else is on the list.

    Null, empty or malformed URLs have an empty host and path, no rule, and are ``unlisted``. Repeated rows are judged
    alike; an empty table gives an empty result; columns named host, path, rule or verdict are replaced.
    """
    if not rules:
        host, path = host_and_path(url_col)
        added = {"host": host, "path": path, "rule": F.lit(None).cast("string"), "verdict": F.lit(unlisted)}
        return pages.withColumns(added)
    # the page's own columns stand aside in a struct, so that no working column can meet one of their names
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"))
    host, path = host_and_path(F.col("_row").getField(url_col))
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    candidate = [
        F.when(
            (F.col("_host") != "") & (F.char_length("_path") >= size),
            F.struct(
                F.substring_index("_host", ".", -labels).alias("host"), F.substring("_path", 1, size).alias("path")
            ),
        )
        for labels, size in shapes
    ]

    def keyed(df: DataFrame) -> DataFrame:
        found = df.withColumns({"_host": host, "_path": path}).withColumn("_parts", F.array_compact(F.array(*candidate)))
        keys = F.transform(F.array_distinct("_parts"), lambda p: F.struct((F.length(p["host"]) + F.length(p["path"])).alias("size"), F.length(p["host"]).alias("host"), F.concat(p["host"], p["path"]).alias("key")))
        return found.withColumn("_keys", keys)

    hashes = F.explode(F.transform("_keys", lambda k: key_hashes(k["key"]))).alias("h")
    universe = cut_lineage(keyed(rows).select(hashes).select("h.a", "h.b").distinct())
    verdicts = sorted({r.verdict for r in rules})
    cascades = [build_cascade([r.key for r in rules if r.verdict == v], universe) for v in verdicts]

    @F.pandas_udf("array<int>")
    def listed(a: pd.Series, b: pd.Series) -> pd.Series:
        """For each key of a row the position of its verdict, or -1."""
        sizes = a.map(len).to_numpy()
        flat = _pairs(np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b]))
        found = np.full(len(flat), -1, dtype=np.int32)
        for place, cascade in enumerate(cascades):
            found[cascade.holds(flat)] = place
        return pd.Series(np.split(found, np.cumsum(sizes)[:-1])) if len(sizes) else pd.Series([], dtype=object)

    probed = keyed(rows).withColumn(
        "_found",
        listed(
            F.transform("_keys", lambda k: key_hashes(k["key"])["a"]), F.transform("_keys", lambda k: key_hashes(k["key"])["b"])
        ),
    )
    matched = F.filter(
        F.zip_with("_keys", "_found", lambda k, f: F.struct(k["size"].alias("size"), k["host"].alias("host"), k["key"].alias("key"), f.alias("found"))),
        lambda m: m["found"] >= 0,
    )
    names = F.array(*[F.lit(v) for v in verdicts])
    best = F.array_max("_matched")
    added = {
        "host": F.col("_host"),
        "path": F.col("_path"),
        "rule": best["key"],
        # element_at alone would not give null for a null position
        "verdict": F.when(best.isNotNull(), F.element_at(names, best["found"] + 1)).otherwise(F.lit(unlisted)),
    }
    own = [F.col("_row").getField(c).alias(c) for c in pages.columns if c not in added]
    return probed.withColumn("_matched", matched).select(*own, *[c.alias(n) for n, c in added.items()])
