"""Identity: the content hash, stable ids, and the two keys of an entry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.functions.urls import encode_component
from feedspark.model import STABLE_ID_PREFIX, nonempty

# Offset basis and prime of 64-bit FNV-1a.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
FEW = 24
"""Texts for which a step of numpy costs more than one of Python for each."""


@F.pandas_udf(T.StringType())
def _fnv1a64(texts: pd.Series) -> pd.Series:
    """Hash a whole Arrow batch at once: one numpy step per character position that many texts reach."""
    given = texts.notna().to_numpy()
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts[given]]
    lengths = np.array([len(u) for u in units], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate(units).astype(np.uint64) if len(units) else np.zeros(0, np.uint64)
    starts = np.cumsum(lengths) - lengths
    starts, ranked = starts[order], lengths[order]
    state = np.full(len(units), FNV_OFFSET, dtype=np.uint64)
    prime = np.uint64(FNV_PRIME)
    active, shared = len(units), int(ranked[FEW]) if len(units) > FEW else 0
    for i in range(shared):
        active = int(np.searchsorted(-ranked[:active], -i, side="left"))
        state[:active] = (state[:active] ^ flat[starts[:active] + i]) * prime
    for k in range(min(FEW, len(units))):
        one = int(state[k])
        for unit in units[order[k]][shared:].tolist():
            one = (one ^ unit) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
        state[k] = one
    digests = np.empty(len(units), dtype=object)
    digests[order] = [format(int(h), "016x") for h in state]
    out = np.full(len(texts), None, dtype=object)
    out[given] = digests
    return pd.Series(out)


def fnv1a64(text: Column) -> Column:
    """64-bit FNV-1a over UTF-16 units as 16 hex characters."""
    return _fnv1a64(text)


def stable_id(link: Column, title: Column) -> Column:
    return F.concat(F.lit(STABLE_ID_PREFIX), fnv1a64(F.concat(link, F.lit("\n"), title)))


def with_stable_id(id_: Column, link: Column, title: Column) -> Column:
    """Keep a real id; a blank one is derived from link and title.

    Rows with an id are sent to the hash as nulls.
    """
    blank = F.coalesce(F.trim(id_), F.lit("")) == ""
    content = F.when(blank, F.concat(link, F.lit("\n"), title))
    return F.coalesce(F.concat(F.lit(STABLE_ID_PREFIX), fnv1a64(content)), id_)


def entry_key(id_: Column, link: Column) -> Column:
    """Identity in a diff: id, else link."""
    return F.coalesce(nonempty(id_), link)


def merge_key(link: Column, id_: Column) -> Column:
    """Identity in a merge: link, else id."""
    return F.coalesce(nonempty(link), id_)


def merged_feed_id(title: Column, namespace: str) -> Column:
    return F.concat(F.lit(namespace), encode_component(title))
