"""Removal of repeated byte strings by longest previous factors.

A byte goes if a string of ``span`` bytes that covers it also starts earlier: in a document with
a smaller id, or before in the same one. Suffixes are sampled by content (`factors.anchors`), so
equal strings are sampled at equal places; samples whose anchor is unique are dropped in a first
exchange, the others meet in buckets by their anchor's hash with the bytes around them. A bucket
sorts its suffixes and finds each one's longest previous factor from the previous and next
smaller places in suffix order.

Buckets grow in number with the bytes of the table. A task first combines what it has: of an
anchor that is frequent in a batch one sample goes on to be counted, and suffixes that have an
earlier match in the batch for all their windows don't go on at all. Equal texts are one text:
all but the first copy are removed whole.

Cases: a null text is empty; a text of less than ``span`` bytes keeps all; rows with a null id
come first; rows with one id and different texts are ordered by a hash of the text; rows that
repeat id and text get one result, that of the first; matches never cross documents, and are
judged on the input, not on what is left. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, cut, sheltered, small_batches, text_bytes
from .factors import anchors, pieces, removed

SPAN, GRAM = 100, 32
BUCKET_BYTES = 12 << 20
FIRST_ID = -(1 << 63)
#: An anchor that a batch holds more often is combined before the exchange.
FREQUENT = 32
_SAMPLES = "bucket INT, hashes BINARY, keys BINARY, places BINARY, known_keys BINARY, known_places BINARY"
_SUFFIXES = (
    "bucket INT, hashes BINARY, docs BINARY, keys BINARY, places BINARY, lefts BINARY, rights BINARY,"
    " lengths BINARY, data BINARY, done_keys BINARY, done_starts BINARY, done_ends BINARY"
)


def _by_bucket(buckets: np.ndarray, columns: dict[str, np.ndarray]) -> dict[int, dict[str, bytes]]:
    if not len(buckets):
        return {}
    order = np.argsort(buckets, kind="stable")
    ordered = {k: v[order] for k, v in columns.items()}
    held, starts = np.unique(buckets[order], return_index=True)
    ends = [*starts[1:].tolist(), len(buckets)]
    return {
        int(b): {k: v[i:j].tobytes() for k, v in ordered.items()}
        for b, i, j in zip(held, starts.tolist(), ends, strict=True)
    }


def _batch(rows: dict[int, dict[str, bytes]], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = [pa.array(list(rows), pa.int32())]
    columns += [pa.array([r.get(n, b"") for r in rows.values()], pa.binary()) for n in names[1:]]
    return pa.RecordBatch.from_arrays(columns, names)


def _frequent(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have a frequent hash, and which are the first of theirs."""
    _, first, inverse, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(hashes), bool)
    is_first[first] = True
    return count[inverse] > FREQUENT, is_first


def _samples(keyed: DataFrame, n_buckets: int, span: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            keys, at = np.unique(batch.column(0).to_numpy(), return_index=True)
            raw, offsets = text_bytes(batch.column(1).take(pa.array(at)))
            hashes, place, _, _ = anchors(raw, offsets, span, gram)
            if not len(hashes):
                continue
            row = np.searchsorted(offsets, place, side="right") - 1
            values = {"hashes": hashes, "keys": keys[row], "places": place - offsets[row]}
            often, first = _frequent(hashes)
            bucket = (hashes & np.uint64(n_buckets - 1)).astype(np.int32)
            send = ~often | first
            rows = _by_bucket(bucket[send], {k: v[send] for k, v in values.items()})
            known = {"known_keys": values["keys"][often], "known_places": values["places"][often]}
            for b, more in _by_bucket(bucket[often], known).items():
                rows.setdefault(b, {}).update(more)
            yield _batch(rows, _SAMPLES)

    return keyed.mapInArrow(run, _SAMPLES)


def _joined(parts: pd.Series, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """Samples whose anchor occurs at two places at least."""
    hashes = _joined(group["hashes"], np.uint64)
    keys, places = _joined(group["keys"]), _joined(group["places"])
    order = np.lexsort([places, keys, hashes])
    h, k, p = hashes[order], keys[order], places[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    h, k, p = h[new], k[new], p[new]
    twice = np.zeros(len(h), bool)
    twice[1:] = h[1:] == h[:-1]
    twice[:-1] |= twice[1:]
    return pd.DataFrame(
        {
            "_key": np.concatenate([k[twice], _joined(group["known_keys"])]),
            "place": np.concatenate([p[twice], _joined(group["known_places"])]),
        }
    )


def _suffixes(texts: DataFrame, n_buckets: int, span: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 << 20):
            raw, offsets = text_bytes(batch.column(2))
            hashes, place, first, last = anchors(raw, offsets, span, gram)
            row = np.searchsorted(offsets, place, side="right") - 1
            wanted = batch.column(3)
            at = np.repeat(offsets[:-1], wanted.value_lengths().to_numpy()) + wanted.flatten().to_numpy()
            keep = np.flatnonzero(np.isin(place, at))
            if not len(keep):
                continue
            hashes, place, first, last, row = (x[keep] for x in (hashes, place, first, last, row))
            doc, key = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            own = place - offsets[row]
            left, right = place - first, place - last
            often, _ = _frequent(hashes)
            i = np.flatnonzero(often)
            done = np.zeros(len(place), bool)
            starts = np.zeros((0, 3), np.int64)
            if len(i):  # what the batch itself can tell of its frequent anchors
                data, ends = pieces(raw, first[i], last[i] + span)
                rank = np.empty(len(i), np.int64)
                rank[np.lexsort([own[i], key[i], doc[i]])] = np.arange(len(i))
                _, _, found = removed(hashes[i], rank, left[i], right[i], data, ends, span, gram)
                all_gone = found == left[i] - right[i] + 1
                done[i[all_gone]] = True
                j = i[all_gone]
                starts = np.stack([key[j], own[j] - left[j], own[j] - right[j] + span], axis=1)
            bucket = (hashes & np.uint64(n_buckets - 1)).astype(np.int32)
            order = np.flatnonzero(~done)
            order = order[np.argsort(bucket[order], kind="stable")]
            data, ends = pieces(raw, first[order], last[order] + span)
            held, begin = np.unique(bucket[order], return_index=True)
            columns = {
                "hashes": hashes, "docs": doc, "keys": key, "places": own,
                "lefts": left.astype(np.int16), "rights": right.astype(np.int16),
            }
            rows: dict[int, dict[str, bytes]] = {}
            for b, x, y in zip(held.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
                rows[b] = {k: v[order[x:y]].tobytes() for k, v in columns.items()}
                rows[b]["lengths"] = np.diff(ends[x : y + 1]).astype(np.int32).tobytes()
                rows[b]["data"] = data[ends[x] : ends[y]].tobytes()
            if done.any():
                spans = dict(zip(("done_keys", "done_starts", "done_ends"), starts.T, strict=True))
                for b, more in _by_bucket(bucket[done], spans).items():
                    rows.setdefault(b, {}).update(more)
            yield _batch(rows, _SUFFIXES)

    return texts.mapInArrow(run, _SUFFIXES)


def _resolved(span: int, gram: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        hashes = _joined(group["hashes"], np.uint64)
        lengths = _joined(group["lengths"], np.int32).astype(np.int64)
        data, ends = _joined(group["data"], np.uint8), np.concatenate([[0], np.cumsum(lengths)])
        _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
        i = np.flatnonzero(count[inverse] > 1)
        key, place, doc = (_joined(group[c])[i] for c in ("keys", "places", "docs"))
        left, right = (_joined(group[c], np.int16)[i].astype(np.int64) for c in ("lefts", "rights"))
        rank = np.empty(len(i), np.int64)
        rank[np.lexsort([place, key, doc])] = np.arange(len(i))
        data, ends = pieces(data, ends[:-1][i], ends[1:][i])
        lo, hi, _ = removed(hashes[i], rank, left, right, data, ends, span, gram)
        gone = lo <= hi
        return pd.DataFrame(
            {
                "_key": np.concatenate([key[gone], _joined(group["done_keys"])]),
                "start": np.concatenate([(place + lo)[gone], _joined(group["done_starts"])]),
                "end": np.concatenate([(place + hi)[gone] + span, _joined(group["done_ends"])]),
            }
        )

    return run


@sheltered
def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """All columns of ``docs`` with ``kept`` (the bytes left), ``n_bytes``, ``n_removed``, ``n_spans``."""
    bounded_batches(docs)
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    text = F.coalesce("text", F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    # both joins below read the same exchange of the texts
    keyed = docs.withColumn("_key", F.xxhash64(text))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = 16
    while n_buckets * BUCKET_BYTES < total:
        n_buckets *= 2
    long_enough = keyed.where(F.octet_length("text") >= span)
    samples = _samples(long_enough.select("_key", "text"), n_buckets, span, gram)
    places = samples.groupBy("bucket").applyInPandas(_shared, "_key BIGINT, place BIGINT")
    places = places.groupBy("_key").agg(F.collect_list("place").alias("_places"))
    firsts = cut(keyed.groupBy("_key").agg(F.min(doc).alias("_first")))
    # not an equality, which would become a join key and part the exchanges
    is_first = (doc <= F.col("_first")) & (doc >= F.col("_first"))
    texts = keyed.join(places.join(firsts, "_key"), "_key").where(is_first)
    suffixes = _suffixes(texts.select("_first", "_key", "text", "_places"), n_buckets, span, gram)
    spans = suffixes.groupBy("bucket").applyInPandas(_resolved(span, gram), "_key BIGINT, start BIGINT, end BIGINT")
    spans = spans.groupBy("_key").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    rows = keyed.join(firsts.join(spans, "_key", "left"), "_key", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    gone = F.when(is_first, F.coalesce("_spans", none)).otherwise(
        F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length(text).cast("long").alias("end")))
    )
    gone = F.when(F.octet_length(text) < span, none).otherwise(gone)
    n = len(docs.columns)
    rows = rows.select(*docs.columns, text.alias("_text"), gone.alias("_gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            raw, offsets = text_bytes(batch.column(batch.schema.get_field_index("_text")))
            cell = batch.column(batch.schema.get_field_index("_gone"))
            per_row = cell.value_lengths().to_numpy()
            flat = cell.flatten()
            base = np.repeat(offsets[:-1], per_row)
            change = np.zeros(len(raw) + 1, np.int64)
            np.add.at(change, base + flat.field("start").to_numpy(), 1)
            np.add.at(change, base + flat.field("end").to_numpy(), -1)
            is_gone = np.cumsum(change[:-1]) > 0
            begins = is_gone.copy()
            begins[1:] &= ~is_gone[:-1]
            first = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[first] = is_gone[first]
            sums = [np.concatenate([[0], np.cumsum(x)])[offsets] for x in (is_gone, begins)]
            left = offsets - sums[0]
            kept = pa.Array.from_buffers(
                pa.large_binary(), batch.num_rows,
                [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[~is_gone]))],
            ).cast(pa.binary())
            columns = [*batch.columns[:n], kept, *(pa.array(np.diff(x)) for x in (offsets, *sums))]
            yield pa.RecordBatch.from_arrays(
                columns, [*batch.schema.names[:n], "kept", "n_bytes", "n_removed", "n_spans"]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    fields += ["kept BINARY", "n_bytes BIGINT", "n_removed BIGINT", "n_spans BIGINT"]
    return rows.mapInArrow(run, ", ".join(fields))


def repeat_report(docs: DataFrame, **settings) -> DataFrame:
    rows = remove_repeats(docs.select("doc_id", "text"), **settings)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
