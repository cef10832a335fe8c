"""Language-model scores by deleted interpolation.

The probability of a token after its predecessor mixes three estimates: the
bigram's and the unigram's relative frequency and a uniform one. The weights
depend on how often the predecessor was seen (one bucket for each doubling) and
are learned by expectation-maximisation: a tenth of the training documents is
deleted from the counts, and the weights make the deleted part most likely under
the counts of the rest. The final model counts all training documents.

How the work is spread: words are known by their 64-bit hashes and counted by a
plain aggregate. Words above a count that at most ``HEAD_WORDS`` words reach are
sent to all tasks. Pairs of such words that make up a large share of all tokens
("of the", or one word over and over) never travel: they are added up within
tasks, and their counts, at most ``HOT_PAIRS``, are sent in the end. Every other
token pair travels once, packed with its neighbours, to the task that counts
this pair: by both tokens if the first is a sent word, so that no word makes a
hot task, else by the first token, which makes its count known there as well.
Pairs whose second token is not a sent word travel on, with what is known of
them by then, to the task that counts this token. So every count is exact, and
which words and pairs are sent changes the work but no score.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_batches, partitions, remainder, saved

# ---- parameters --------------------------------------------------------------
FOLDS, HELD_OUT = 5, 1
#: One training document in so many is deleted from the counts while weights are learned.
DELETED = 10
HEAD_WORDS = 1 << 18
#: Pairs that do not travel; one over SHARE of a chunk's tokens is looked at.
HOT_PAIRS = 1 << 16
SHARE = 1 << 13
#: Counts that a task holds before it hands them on.
HELD_COUNTS = 1 << 18
#: Tokens counted by one task.
TASK_TOKENS = 1 << 20
EM_ROUNDS = 60
CONTEXT_BUCKETS = 40
# ------------------------------------------------------------------------------

END = b""  # no word is empty
TEST, TRAIN, PART = 0, 1, 2  # held out; counted; counted and deleted while learning
STEPS, LEVELS = 8, 320  # learning counts are binned at an eighth of a doubling, down to 2 ** -40
CODEC = "zstd"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, four-byte numbers by planes, which pack better."""
    planes = [a.view(np.uint8).reshape(-1, 4).T.copy() if a.dtype == np.uint32 else a for a in arrays]
    raw = pickle.dumps(planes, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=CODEC, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec=CODEC, asbytes=True)
    return [a.T.copy().view(np.uint32).ravel() if a.ndim == 2 else a for a in pickle.loads(raw)]


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens, the tokens as numbers, and how many each text has."""
    known: dict[bytes, int] = {}
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in tokens_of(t)), np.int64) for t in texts]
    return list(known), np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``keys`` (two columns) that are equal made one, with the sums of ``counts`` (two columns)."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.lexsort((key[:, 1], key[:, 0]))
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]).any(axis=1)
    return key[first], np.add.reduceat(count[order], np.flatnonzero(first), axis=0) if len(key) else count


def count_words(rows: DataFrame) -> DataFrame:
    """``(h, h2, c, deleted)`` of the training rows of ``rows(text, role)``.

    ``h`` is a word's hash (the end is the empty word) and ``h2`` null; or both
    are those of a pair that is frequent in some chunk, counted there.
    """

    def handed_on(keys, counts, is_pair):
        second = pa.array(keys[:, 1].view(np.int64), mask=np.full(len(keys), not is_pair))
        columns = [pa.array(keys[:, 0].copy().view(np.int64)), second, pa.array(counts[:, 0].copy()), pa.array(counts[:, 1].copy())]
        return pa.RecordBatch.from_arrays(columns, ["h", "h2", "c", "deleted"])

    def run(batches):
        held = {False: ([], []), True: ([], [])}

        def add(is_pair, first, second, c, deleted):
            keys, counts = held[is_pair]
            keys.append(np.stack([first, second], axis=1))
            counts.append(np.stack([c, deleted], axis=1))
            if sum(map(len, keys)) > 2 * HELD_COUNTS:
                key, count = _summed(keys, counts)
                held[is_pair] = ([key], [count])
                if len(key) > HELD_COUNTS:
                    held[is_pair] = ([], [])
                    yield handed_on(key, count, is_pair)

        for batch, texts in chunks(batches, "text"):
            words, ids, lengths = _numbered(texts)
            hashes = _hashes(words)
            role = np.repeat(batch.column("role").to_numpy(zero_copy_only=False), lengths)
            c = np.bincount(ids[role != TEST], minlength=len(words))
            deleted = np.bincount(ids[role == PART], minlength=len(words))
            seen = np.nonzero(c)[0]
            yield from add(False, hashes[seen], np.zeros(len(seen), np.uint64), c[seen], deleted[seen])
            before = np.empty_like(ids)
            before[1:] = ids[:-1]
            before[np.cumsum(lengths) - lengths] = words.index(END)
            pair, n = np.unique((before * len(words) + ids)[role != TEST], return_counts=True)
            often = n >= max(4, len(ids) // SHARE)
            first, second = np.divmod(pair[often], len(words))
            yield from add(True, hashes[first], hashes[second], n[often], np.zeros(int(often.sum()), np.int64))
        for is_pair, (keys, counts) in held.items():
            if keys:
                yield handed_on(*_summed(keys, counts), is_pair)

    counted = map_batches(rows.select("text", "role"), "h long, h2 long, c long, deleted long", run)
    return counted.groupBy("h", "h2").agg(F.sum("c").alias("c"), F.sum("deleted").alias("deleted"))


def _unsigned(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _head(counted: DataFrame, head_words: int) -> dict:
    """The words whose count reaches a bound met by at most ``head_words`` words, frequent pairs of them, and totals over all words."""
    words = counted.where("h2 is null")
    doubling = F.floor(F.log2("c") * 16).cast("int")
    bins = sorted(words.groupBy(doubling.alias("bin")).agg(F.count(F.lit(1)), F.sum("c"), F.sum("deleted"), F.min("c")).collect(), reverse=True)
    least, taken = None, 0
    for _, n, _, _, low in bins:
        if taken + n > head_words:
            break
        taken, least = taken + n, low
    found = words.where(F.col("c") >= least).toArrow() if least is not None else words.limit(0).toArrow()  # at most head_words
    hashes, c = _unsigned(found.column("h")), found.column("c").to_numpy()
    order = np.lexsort((hashes, -c))  # frequent words have low numbers
    total, types, deleted = (sum(b[k] for b in bins) for k in (2, 1, 3))
    head = {
        "hashes": hashes[order],
        "c": c[order].astype(np.float64),
        "deleted": found.column("deleted").to_numpy()[order].astype(np.float64),
        "N": int(total),
        "V": int(types),
        "N_deleted": int(deleted),
    }
    # At most HOT_PAIRS rows. A pair of 1/4096 of all tokens or more is among them: chunks in which it
    # is rarer than 1/SHARE hold no more than half of it.
    often = counted.where(F.col("h2").isNotNull() & (F.col("c") >= head["N"] >> 16)).orderBy(F.desc("c"), "h", "h2").limit(HOT_PAIRS).toArrow()
    first, second = (_places(head, _unsigned(often.column(k))) for k in ("h", "h2"))
    sent = (first >= 0) & (second >= 0)
    head["hot"] = np.sort(first[sent].astype(np.uint64) << np.uint64(32) | second[sent].astype(np.uint64))
    return head


def _places(head: dict, hashes: np.ndarray) -> np.ndarray:
    """The numbers of sent words, -1 for others."""
    if not len(head["hashes"]):
        return np.full(len(hashes), -1, np.int64)
    order = head.setdefault("order", np.argsort(head["hashes"], kind="stable"))
    at = order[np.minimum(np.searchsorted(head["hashes"], hashes, sorter=order), len(order) - 1)]
    return np.where(head["hashes"][at] == hashes, at, -1)


def _dealt(group: np.ndarray):
    """Every group there is, with the places of its members in order."""
    order = np.argsort(group, kind="stable")
    own, cuts = np.unique(group[order], return_index=True)
    return zip(own.tolist(), np.split(order, cuts[1:]))


def _spread(rows: DataFrame, shared, groups: int) -> DataFrame:
    """Rows ``(p, kind, chunk, data)``: token pairs (kind 0), what is known of each text (2) and counts of hot pairs (4)."""

    def run(batches):
        head = shared.value
        n_head, log_c, hot = len(head["c"]), np.log10(head["c"] + 0.5), head["hot"]
        for batch, texts in chunks(batches, "text"):
            words, ids, lengths = _numbered(texts)
            hashes = _hashes(words)
            place = _places(head, hashes)
            # Words that are not sent have one number here and their hashes beside it.
            codes = np.where(place >= 0, place, n_head).astype(np.uint32)
            code, common, hashed = codes[ids], place[ids] >= 0, hashes[ids]
            text_of = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)
            role = batch.column("role").to_numpy(zero_copy_only=False).astype(np.uint8)
            chunk = batch.column("row")[0].as_py()
            starts = np.cumsum(lengths) - lengths
            before, earlier = np.empty_like(code), np.empty_like(hashed)
            before[1:], earlier[1:] = code[:-1], hashed[:-1]
            end = words.index(END)  # a text begins after an end
            before[starts], earlier[starts] = codes[end], hashes[end]
            mixed = np.where(before < n_head, earlier * np.uint64(0xD6E8FEB86659FD93) + hashed, earlier)
            group = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(groups)
            out = []
            if len(hot):
                key = before.astype(np.uint64) << np.uint64(32) | code
                of = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                stays = common & (before < n_head) & (hot[of] == key)
            else:
                of, stays = np.zeros(len(code), np.int64), np.zeros(len(code), bool)
            by_text, n = np.unique(text_of[stays].astype(np.int64) * max(len(hot), 1) + of[stays], return_counts=True)
            own, which = np.divmod(by_text, max(len(hot), 1))
            kept = _pack(own.astype(np.uint32), which.astype(np.uint32), n.astype(np.uint32))
            for deleted, roles in ((0, role != TEST), (1, role == PART)):
                at, total = np.unique(which[roles[own]], return_inverse=True)
                if len(at):
                    out.append((chunk % groups, 4 + deleted, chunk, pickle.dumps((at, np.bincount(total, n[roles[own]]).astype(np.int64)))))
            travels = np.flatnonzero(~stays)
            for g, at in _dealt(group[travels].astype(np.uint16 if groups < 65536 else np.int32)):
                at = travels[at]
                texts_, n = np.unique(text_of[at], return_counts=True)
                rare = earlier[at[before[at] == n_head]], hashed[at[~common[at]]]
                out.append((g, 0, chunk, _pack(texts_, n.astype(np.uint32), role[texts_], before[at], code[at], *rare)))
            base = np.add.reduceat(np.where(common, log_c[np.where(common, code, 0)] if n_head else 0.0, 0.0), starts)
            known = np.add.reduceat(common.astype(np.int64), starts)
            doc_ids = pickle.dumps(batch.column("doc_id").to_pylist())
            out.append((chunk % groups, 2, chunk, pickle.dumps((doc_ids, role, lengths, known, base, kept))))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["p", "kind", "chunk", "data"])

    return map_batches(rows, "p int, kind int, chunk long, data binary", run)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for zero, else one bin for each eighth of a doubling."""
    level = np.round(-np.log2(np.maximum(p, 1e-300)) * STEPS)
    return np.where(p > 0, 1 + np.clip(level, 0, LEVELS - 2), 0).astype(np.int64)


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(c + 1)), CONTEXT_BUCKETS - 1).astype(np.int64)


COUNTED = "p int, kind int, chunk long, data binary, bins array<long>, counts array<long>"


def _counted_rows(rows) -> Iterator[pa.RecordBatch]:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["p", "kind", "chunk", "data", "bins", "counts"])


def _binned(first: np.ndarray, both: np.ndarray, uni: np.ndarray) -> tuple:
    """A row of kind 3 from deleted tokens: the counts of the rest, binned."""
    bins, counts = np.unique((_bucket(first) * LEVELS + _bin(both / np.maximum(first, 1))) * LEVELS + _bin(uni), return_counts=True)
    return None, 3, 0, None, bins.tolist(), counts.tolist()


def _first(head: dict, before: np.ndarray) -> np.ndarray:
    """The context's count, from what ``_count_pairs`` writes for it."""
    n_head = len(head["c"])
    return np.where(before < n_head, np.append(head["c"], 0.0)[np.minimum(before, n_head)], before.astype(np.float64) - n_head)


def _count_pairs(spread: DataFrame, shared, groups: int) -> DataFrame:
    """``COUNTED`` rows: for each text's sent tokens the pair's count, context and token (kind 0), all that is known of
    pairs with other tokens, dealt by the token (1), texts as before (2), binned counts of the deleted part (3), and counts
    of hot pairs (4; 5: of the deleted part)."""

    def pairs(rows, head):
        n_head = len(head["c"])
        parts = [_unpack(r[1]) for r in rows]
        before, code, earlier, hashed = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5, 6))
        role = np.concatenate([np.repeat(p[2], p[1]) for p in parts])
        train, part = role != TEST, role == PART
        # Words that are not sent get numbers of this task, told apart by all 64 bits.
        rare, others = np.nonzero(before == n_head)[0], np.nonzero(code == n_head)[0]
        _, numbers = np.unique(np.concatenate([earlier, hashed]), return_inverse=True)
        first, second = before.astype(np.uint64), code.astype(np.uint64)
        first[rare] += numbers[: len(rare)].astype(np.uint64)
        second[others] += numbers[len(rare) :].astype(np.uint64)
        _, at = np.unique(first << np.uint64(32) | second, return_inverse=True)
        both = np.bincount(at, train)[at].astype(np.uint32)
        left = (both - np.bincount(at, part)[at]).astype(np.uint32)
        del at, second
        # A context outside the sent words is counted here, and stands for itself by its count.
        part_of = np.append(head["deleted"], 0.0)[np.minimum(before, n_head)]
        if len(rare):
            _, own = np.unique(first[rare], return_inverse=True)
            part_of[rare] = np.bincount(own, part[rare])[own]
            before[rare] = n_head + np.bincount(own, train[rare])[own].astype(np.uint32)
            del own
        first_left = _first(head, before) - part_of
        common = code < n_head
        deleted = np.nonzero(part & common)[0]
        c_left = (head["c"] - head["deleted"])[code[deleted]] if n_head else np.zeros(0)
        yield _binned(first_left[deleted], left[deleted], c_left / max(head["N"] - head["N_deleted"], 1))

        texts = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        low = 0
        for (chunk, _), p in zip(rows, parts):
            high = low + len(p[3])
            sent = low + np.nonzero(common[low:high])[0]
            if len(sent):
                own, n = np.unique(texts[sent], return_counts=True)
                yield None, 0, chunk, _pack(own, n.astype(np.uint32), both[sent], before[sent], code[sent]), None, None
            low = high
        if len(others):
            chunk_of = np.concatenate([np.full(len(p[3]), chunk, np.int64) for (chunk, _), p in zip(rows, parts)])[others]
            known = [chunk_of, texts[others], role[others], hashed, both[others], before[others], left[others], first_left[others]]
            for g, own in _dealt(((hashed >> np.uint64(20)) % np.uint64(groups)).astype(np.int32)):
                yield g, 1, 0, _pack(*[v[own] for v in known]), None, None

    def run(batches):
        by_task: dict[int, list] = {}
        for batch in batches:
            for p, kind, chunk, data in zip(*(batch.column(c).to_pylist() for c in ("p", "kind", "chunk", "data"))):
                if kind == 0:
                    by_task.setdefault(p, []).append((chunk, data))
                elif kind > 3:
                    at, total = pickle.loads(data)
                    yield from _counted_rows([(None, kind, chunk, None, at.tolist(), total.tolist())])
                else:
                    yield from _counted_rows([(None, kind, chunk, data, None, None)])
        for rows in by_task.values():
            yield from _counted_rows(pairs(rows, shared.value))

    return map_batches(spread, COUNTED, run)


def _count_others(dealt: DataFrame, shared) -> DataFrame:
    """``COUNTED`` rows from those of kind 1: by text the pair's count, context and the token's own count (1), and bins (3)."""

    def counted(data, head):
        chunk, text, role, hashed, both, before, left, first_left = (np.concatenate(c) for c in zip(*map(_unpack, data)))
        part = role == PART
        _, at = np.unique(hashed, return_inverse=True)
        c = np.bincount(at, role != TEST)[at]
        c_left = (c - np.bincount(at, part)[at])[part]
        yield _binned(first_left[part], left[part], c_left / max(head["N"] - head["N_deleted"], 1))
        c = c.astype(np.uint32)
        for of, places in _dealt(chunk):
            places = places[np.argsort(text[places], kind="stable")]
            own, n = np.unique(text[places], return_counts=True)
            yield None, 1, of, _pack(own, n.astype(np.uint32), both[places], before[places], c[places]), None, None

    def run(batches):
        by_task: dict[int, list] = {}
        for batch in batches:
            for p, data in zip(batch.column("p").to_pylist(), batch.column("data").to_pylist()):
                by_task.setdefault(p, []).append(data)
        for data in by_task.values():
            yield from _counted_rows(counted(data, shared.value))

    return map_batches(dealt, COUNTED, run)


def learn_weights(bins: np.ndarray, counts: np.ndarray, uniform: float) -> np.ndarray:
    """Per context bucket the weights of bigram, unigram and uniform estimate, by expectation-maximisation.

    A bucket without deleted tokens takes the weights learned over all buckets.
    """
    value = lambda level: np.where(level > 0, 2.0 ** (-(level - 1) / STEPS), 0.0)
    p = np.stack([value(bins // LEVELS % LEVELS), value(bins % LEVELS), np.full(len(bins), uniform)])
    bucket = bins // (LEVELS * LEVELS)

    def fitted(p, counts):
        weight = np.full(3, 1 / 3)
        for _ in range(EM_ROUNDS):
            share = weight[:, None] * p
            expected = (share / share.sum(axis=0) * counts).sum(axis=1)
            weight = np.maximum(expected / expected.sum(), 1e-6)
            weight /= weight.sum()
        return weight

    pooled = fitted(p, counts) if len(bins) else np.full(3, 1 / 3)
    out = np.tile(pooled, (CONTEXT_BUCKETS, 1))
    for b in np.unique(bucket):
        out[b] = fitted(p[:, bucket == b], counts[bucket == b])
    return out


def _probability(head: dict, weights: np.ndarray, both, first, c) -> np.ndarray:
    w = weights[_bucket(first)]
    return w[:, 0] * both / np.maximum(first, 1) + w[:, 1] * c / max(head["N"], 1) + w[:, 2] / (head["V"] + 1)


def _hot_counts(counted: DataFrame, head: dict) -> tuple[np.ndarray, np.ndarray]:
    """How often each hot pair was seen, and in the deleted part."""
    rows = counted.where("kind > 3").select("kind", F.explode(F.arrays_zip("bins", "counts")).alias("x"))
    both, deleted = np.zeros(len(head["hot"])), np.zeros(len(head["hot"]))
    for kind, at, n in rows.groupBy("kind", "x.bins").agg(F.sum("x.counts")).collect():  # at most two per hot pair
        (both if kind == 4 else deleted)[at] = n
    return both, deleted


def _scores(counted: DataFrame, weights: np.ndarray, shared, hot_logs: np.ndarray) -> DataFrame:
    def summed(batches):
        head = shared.value
        for batch in batches:
            kinds, data = batch.column("kind").to_pylist(), batch.column("data").to_pylist()
            for k in (k for k, kind in enumerate(kinds) if kind < 2):
                own, counts, both, before, token = _unpack(data[k])
                first = _first(head, before)
                c = token.astype(np.float64) if kinds[k] else head["c"][token]
                p = _probability(head, weights, both, first, c)
                starts = np.cumsum(counts.astype(np.int64)) - counts
                sums = [np.add.reduceat(np.log10(p), starts)]
                if kinds[k]:
                    sums += [np.add.reduceat(np.log10(c + 0.5), starts), np.add.reduceat((c > 0).astype(np.int64), starts)]
                data[k] = _pack(own, *sums)
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("kind"), pa.array(data, pa.binary())], ["chunk", "kind", "data"])

    def run(table: pa.Table) -> pa.Table:
        head = shared.value
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        doc_ids, role, lengths, known, base, kept = pickle.loads(data[kinds.index(2)])
        known, base = known.copy(), base.copy()
        own, which, n = _unpack(kept)
        score = np.bincount(own, n * hot_logs[which], len(lengths)).astype(np.float64)
        for kind, packed in zip(kinds, data):
            if kind == 0:
                own, logs = _unpack(packed)
                score[own] += logs
            elif kind == 1:
                own, logs, base_logs, seen = _unpack(packed)
                score[own] += logs
                base[own] += base_logs
                known[own] += seen
        base = base - lengths * math.log10(head["N"] + 0.5 * (head["V"] + 1))
        columns = {
            "doc_id": pa.array(pickle.loads(doc_ids), pa.int64()),
            "held_out": pa.array(role == TEST),
            "n_tokens": pa.array(lengths, pa.int64()),
            "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array(np.full(len(lengths), head["N"]), pa.int64()),
            "base_score": pa.array(base, pa.float64()),
            "score": pa.array(score, pa.float64()),
        }
        return pa.table(columns)

    parts = map_batches(counted.where("kind < 3").select("chunk", "kind", "data"), "chunk long, kind int, data binary", summed)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.groupBy("chunk").applyInArrow(run, schema)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    Null texts are empty: one end. Rows whose id's crc32 modulo 5 is 1 teach
    nothing; a null id counts as the text "". Repeated rows are counted and
    scored each; an empty table gives an empty one; without training rows the
    uniform estimate is all there is.
    """
    spark = docs.sparkSession
    id_ = docs[id_col].cast("long")
    part = F.pmod(F.xxhash64(F.lit("deleted"), id_), F.lit(DELETED)) == 0
    role = F.when(remainder(id_, FOLDS) == HELD_OUT, TEST).when(part, PART).otherwise(TRAIN)
    rows = docs.select(id_.alias("doc_id"), docs[text_col].cast("string").alias("text"), role.cast("int").alias("role"))
    head = _head(saved(count_words(rows), "words"), head_words)
    shared = spark.sparkContext.broadcast(head)
    groups = max(partitions(spark), math.ceil(head["N"] / TASK_TOKENS))
    spread = _spread(rows.withColumn("row", F.monotonically_increasing_id()), shared, groups)
    counted = saved(_count_pairs(spread.repartitionById(groups, F.col("p")), shared, groups), "pairs")
    dealt = counted.where("kind = 1").select("p", "data").repartitionById(groups, F.col("p"))
    counted = counted.where("kind <> 1").union(saved(_count_others(dealt, shared), "others"))
    both, deleted = _hot_counts(counted, head)
    first, second = (head["hot"] >> np.uint64(32)).astype(np.int64), (head["hot"] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    learned = counted.where("kind = 3").select(F.explode(F.arrays_zip("bins", "counts")).alias("x")).groupBy("x.bins").agg(F.sum("x.counts").alias("n"))
    bins = learned.orderBy("bins").collect()  # at most CONTEXT_BUCKETS * LEVELS ** 2, in fact some ten thousand
    left, part = head["c"] - head["deleted"], deleted > 0
    hot_uni = left[second[part]] / max(head["N"] - head["N_deleted"], 1)
    hot_bins = (_bucket(left[first[part]]) * LEVELS + _bin((both - deleted)[part] / np.maximum(left[first[part]], 1))) * LEVELS + _bin(hot_uni)
    all_bins = np.concatenate([np.array([b[0] for b in bins], np.int64), hot_bins])
    counts = np.concatenate([np.array([b[1] for b in bins], np.float64), deleted[part]])
    order = np.argsort(all_bins, kind="stable")
    weights = learn_weights(all_bins[order], counts[order], 1.0 / (head["V"] + 1))
    hot_logs = np.log10(_probability(head, weights, both, head["c"][first], head["c"][second])) if len(first) else np.zeros(1)
    return _scores(counted, weights, shared, hot_logs)
