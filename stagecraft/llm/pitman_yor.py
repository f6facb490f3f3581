"""Score texts with a hierarchical Pitman-Yor language model of word pairs.

Each word is a context restaurant whose customers are the words that follow it in training
and whose tables each send one customer to the parent, a root restaurant that all contexts
share; its base is uniform over the known words and one unknown. Given the tables t of a
dish with c customers, a restaurant predicts (c - d t + (s + d T) parent) / (s + C).

Work moves in parcels of packed arrays, never token by token:

1. Tasks gather documents into chunks of about ``CHUNK`` bytes, reduce each chunk to its
   distinct pairs and deal these by context to shards, one for ``SHARD`` bytes; a context with more than a shard's
   fair share of the words (found on a sample, which only balances) is dealt by pair. So a
   pair crosses the network once a chunk, however frequent it is. A shard numbers its pairs,
   counts them and keeps which documents hold them.
2. Shards send the tables of their dishes to the root, dealt by word, which sums them, seats
   the customers and answers with what each shard's words need.
3. ``EPOCHS`` times the shards seat their customers by Gibbs sampling with the root's answers.
   Each sweep seats all customers of a dish at once, however many, from the exact conditional
   of their tables given all others (generalised Stirling numbers: from a table of them up to
   ``EXACT`` customers, by ``stirling`` above). Dishes of one restaurant are seated at the
   same time, given the other tables of the sweep before; ``BURN`` sweeps go by, the tables of
   the others are averaged. ``arrive`` and ``move`` seat one customer at a time; the draws are
   tested against them.
4. Predictive probabilities are averaged over these seatings and over ``DRAWS`` of the root.
   A shard scores its pairs, sums them by document, and chunks add up their shards.

Discounts come from counts of counts. Draws are seeded by shard and epoch. Words are
compared by 64-bit hashes; a context is the word before, the end mark for the first.

Defined results: a null text is empty and has one token, the end. A null doc_id is not held
out; rows of one doc_id are documents of their own. Without training rows every word is
unknown. Words of any number and length are read whole; a long document fills several
chunks. An empty table has no rows.
"""

from __future__ import annotations

import ctypes
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.llm.stirling import draw_many_tables
from stagecraft.llm.words import mix, word_hashes
from stagecraft.scratch import batches_up_to, materialise

CHUNK, SHARD, PIECE, BATCH = 5 << 20, 8 << 20, 1_000_000, 512
EPOCHS, SWEEPS, BURN, DRAWS, EXACT, SEED = 2, 4, 1, 4, 1024, 1
STRENGTH, HELD_PARTS, HELD = 1.0, 5, 1
END = np.uint64(0x656E64)
_PARCEL = "to bigint, sender bigint, kind string, parts array<binary>, sums array<double>"
_SCHEMA = pa.schema([("to", pa.int64()), ("sender", pa.int64()), ("kind", pa.string()),
                     ("parts", pa.list_(pa.binary())), ("sums", pa.list_(pa.float64()))])


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Non-negative integers (differences, if they rise) or floats, by byte planes."""
    if values.dtype.kind == "f":
        width, flat = values.dtype.itemsize, values
    else:
        values = values.astype(np.uint64)
        if rising and len(values):
            values = np.concatenate((values[:1], np.diff(values)))
        most = int(values.max()) if len(values) else 0
        width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
        flat = values.astype(f"<u{width}")
    planes = np.ascontiguousarray(flat).view(np.uint8).reshape(-1, width).T
    return struct.pack("<cBQ", values.dtype.kind.encode(), width, len(values)) + pa.compress(
        planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    kind, width, n = struct.unpack_from("<cBQ", data)
    plain = pa.decompress(data[10:], n * width, codec="zstd", asbytes=True)
    flat = np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(width, n).T)
    if kind == b"f":
        return flat.view(f"<f{width}").ravel()
    values = flat.view(f"<u{width}").ravel().astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if rising else values


def _int(data: bytes, rising: bool = False) -> np.ndarray:
    return unpack(data, rising).astype(np.int64)


def _parcels(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(_SCHEMA)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _given_back(table: pa.Table) -> pa.Table:
    """Freed memory goes back to the system: a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    return table


def _by_kind(table: pa.Table) -> dict[str, list[tuple]]:
    """kind -> (sender, parts) in order of sender."""
    out: dict[str, list] = {}
    columns = (table[c].to_pylist() for c in ("sender", "kind", "parts"))
    for sender, kind, parts in sorted(zip(*columns), key=lambda r: (r[0], r[1])):
        out.setdefault(kind, []).append((sender, parts))
    return out


# ---- 1. chunks and shards ------------------------------------------------------------------

def shard_of(v: np.ndarray, w: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    split = np.isin(v, hot)
    return (mix(np.where(split, mix(v) + w, v)) % np.uint64(shards)).astype(np.int64)


def root_of(words: np.ndarray, shards: int) -> np.ndarray:
    """The root's shard of each word: an interval of hashes, so sorted words are grouped."""
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _numbered(left, right, size):
    """Sorted distinct numbers of two lists below ``size``, and the lists in these numbers."""
    if len(left) * 8 < size:
        ids, at = np.unique(np.concatenate((left, right)), return_inverse=True)
        return ids, at[: len(left)], at[len(left):]
    seen = np.zeros(size, bool)
    seen[left] = seen[right] = True
    number = np.cumsum(seen) - 1
    return np.flatnonzero(seen), number[left], number[right]


def _blocks(chunk: int, firsts, lengths, w, heads, hot, shards):
    """Parcels of one chunk: for each shard the distinct pairs and the documents of each.
    ``firsts`` are the contexts of the pieces' first words; the others' is the word before."""
    words, place = np.unique(np.concatenate((w, firsts)), return_inverse=True)
    key = np.empty(len(w), np.int64)
    key[1:] = place[: len(w) - 1]
    key[np.cumsum(lengths) - lengths] = place[len(w):]
    key *= len(words)
    key += place[: len(w)]
    del place, w
    order = np.argsort(key)
    key, doc = key[order], np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[order]
    del order
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(np.append(first, len(key)))
    left, right = np.divmod(key[first], len(words))
    shard = shard_of(words[left], words[right], hot, shards)
    small = shard.astype(np.uint16) if shards < 1 << 16 else shard
    by_shard = np.argsort(small, kind="stable")
    edges = np.searchsorted(small[by_shard], np.arange(shards + 1).astype(small.dtype))
    edges[-1] = len(by_shard)
    held = np.packbits(heads[1].astype(np.uint8)).tobytes()
    for s in range(shards):
        pick = by_shard[edges[s]:edges[s + 1]]
        if len(pick):
            ids, lower, upper = _numbered(left[pick], right[pick], len(words))
            n = times[pick]
            # Places of the picked pairs' tokens in the sorted token list.
            start = np.repeat(first[pick] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            yield s, chunk, "block", [
                pack(words[ids], True), pack(lower, True), pack(upper), pack(n),
                pack(doc[start + np.arange(n.sum())]), held], None
    yield chunk % shards, chunk, "head", [pack(h) for h in heads], None


def _chunks(batches, hot, shards, size):
    """Parcels of all chunks of a partition."""
    task, number = TaskContext.get().partitionId(), 0
    w, firsts, lengths, ids, null, held, tag_chunk, tag_doc = kept = [[] for _ in range(8)]
    gathered = 0

    def flush():
        nonlocal number, gathered
        heads = (np.array(ids, np.int64).view(np.uint64), *(np.array(x, np.int64) for x in (
            held, null, tag_chunk, tag_doc)))
        yield from _blocks((task << 32) + number, np.array(firsts, np.uint64), np.array(lengths),
                           np.concatenate(w), heads, hot, shards)
        for column in kept:
            column.clear()
        number, gathered = number + 1, 0

    for batch in batches:
        for doc_id, is_held, text in zip(batch["doc_id"], batch["held"], batch["text"]):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
            tokens, known = np.append(word_hashes(data)[2], END), doc_id.as_py()
            tag = ((task << 32) + number, len(lengths))
            for at in range(0, len(tokens), PIECE):
                firsts.append(tokens[at - 1] if at else END)
                w.append(tokens[at:at + PIECE])
                lengths.append(len(w[-1]))
                ids.append(0 if known is None else known)
                null.append(known is None)
                held.append(is_held.as_py())
                tag_chunk.append(tag[0])
                tag_doc.append(tag[1])
                gathered += 6 * lengths[-1]
                if gathered >= size:
                    yield from flush()
    if lengths:
        yield from flush()


def _merge(table: pa.Table, shards: int) -> list[tuple]:
    """One shard's pairs, the documents of its blocks, and what it asks the root."""
    kinds = _by_kind(table)
    out = [(sender, sender, "head", parts, None) for sender, parts in kinds.get("head", [])]
    blocks = kinds.get("block", [])
    if not blocks:
        return out
    shard = table["to"][0].as_py()
    words = np.unique(np.concatenate([unpack(parts[0], True) for _, parts in blocks]))
    key, train = [], []
    for _, (ids, left, right, times, docs, held) in blocks:
        place, times = np.searchsorted(words, unpack(ids, True)), _int(times)
        learned = np.unpackbits(np.frombuffer(held, np.uint8))[_int(docs)] == 0
        key.append(place[_int(left, True)] * len(words) + place[_int(right)])
        train.append(np.add.reduceat(learned.astype(np.int32), np.cumsum(times) - times))
    ends = np.cumsum([len(k) for k in key])
    pairs, of = np.unique(np.concatenate(key), return_inverse=True)
    del key
    left, right = np.divmod(pairs, len(words))
    count = np.bincount(of, np.concatenate(train), len(pairs)).astype(np.int64)
    del train, pairs
    for (chunk, parts), end, start in zip(blocks, ends, [0, *ends]):
        # Words are in order of their hashes in the block and here, so pairs rise.
        out.append((shard, chunk, "tokens", [pack(of[start:end], True), parts[3], parts[4]], None))
    del of
    ones, several = count == 1, np.flatnonzero(count > 1)
    size = len(words)
    bounds = np.searchsorted(root_of(words, shards), np.arange(shards + 1))
    dish, context = (np.bincount(x[ones], minlength=size) for x in (right, left))
    out.append((shard, shard, "pairs", [pack(left, True), pack(right), pack(count), pack(bounds, True)], None))
    out.append((shard, shard, "several", [
        pack(left[several], True), pack(right[several]), pack(count[several]), pack(dish), pack(context),
        pack(bounds, True)], [float(ones.sum()), float((count == 2).sum())]))
    customers = np.bincount(right, count, size).astype(np.int64)
    dish = np.bincount(right[count > 0], minlength=size)
    context = np.bincount(left[count > 0], minlength=size)
    for r, low, high in _spans(bounds):
        out.append((r, shard, "ask", [pack(words[low:high], True), *(
            pack(x[low:high]) for x in (dish, context, customers))], None))
    return out


def _spans(bounds: np.ndarray):
    """(root shard, first, end) of the words that one root shard owns."""
    for r in np.flatnonzero(np.diff(bounds)).tolist():
        yield r, int(bounds[r]), int(bounds[r + 1])


# ---- 2. seating ----------------------------------------------------------------------------

def log_stirling(discount: float, most: int) -> np.ndarray:
    """Logs of the generalised Stirling numbers: ways to seat c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = np.where(c - t * discount > 0, np.log(np.maximum(c - t * discount, 1e-300)), -np.inf)
            out[c + 1] = np.logaddexp(out[c] + stay, np.concatenate(([-np.inf], out[c][:-1])))
    return out


def draw_tables(rng, count, others, parent, strength, discount, stirling) -> np.ndarray:
    """Tables of dishes with 2..EXACT customers, given the other tables of their restaurants
    and the parent's probabilities: p(t) ~ S(c, t) parent^t prod (strength + discount T)."""
    out = np.ones(len(count), np.int64)
    order = np.argsort(count, kind="stable")
    sizes, starts = np.unique(count[order], return_index=True)
    for c, at, end in zip(sizes.tolist(), starts.tolist(), [*starts.tolist()[1:], len(order)]):
        for low in range(at, end, max(1, 1_000_000 // c)):
            rows = order[low:min(end, low + max(1, 1_000_000 // c))]
            more = np.log(strength + discount * (others[rows, None] + np.arange(c)))
            score = np.cumsum(more + np.log(parent[rows, None]), axis=1) + stirling[c, 1:c + 1]
            weight = np.cumsum(np.exp(score - score.max(axis=1, keepdims=True)), axis=1)
            u = rng.random(len(rows)) * weight[:, -1]
            out[rows] = 1 + (weight < u[:, None]).sum(axis=1)
    return out


def arrive(rng, count: int, others: int, parent: float, strength: float, discount: float) -> np.ndarray:
    """Table sizes of a dish whose customers come in one after another."""
    sizes, seated = np.ones(1, np.int64), 1
    while seated < count:
        batch = min(count - seated, 1 + seated // 8)
        new = (strength + discount * (others + len(sizes))) * parent
        old = seated - discount * len(sizes)
        opened = rng.binomial(batch, new / (new + old))
        if opened < batch:
            share = sizes - discount
            sizes = sizes + rng.multinomial(batch - opened, share / share.sum())
        sizes, seated = np.append(sizes, np.ones(opened, np.int64)), seated + batch
    return sizes


def move(rng, sizes: np.ndarray, others: int, parent: float, strength: float, discount: float) -> np.ndarray:
    """One customer gets up and sits down again."""
    at = np.searchsorted(np.cumsum(sizes), rng.random() * sizes.sum(), "right")
    sizes = sizes.copy()
    sizes[at] -= 1
    sizes = sizes[sizes > 0]
    new = (strength + discount * (others + len(sizes))) * parent
    u = rng.random() * (new + sizes.sum() - discount * len(sizes))
    if u < new:
        return np.append(sizes, 1)
    sizes[np.searchsorted(np.cumsum(sizes - discount), u - new, "right").clip(0, len(sizes) - 1)] += 1
    return sizes


def gibbs(rng, left, count, tables, others, parent, strength, discount, *, sweeps, burn):
    """Tables after the last sweep and averaged over those after ``burn``. ``left``: restaurant
    of each dish; ``others``: tables of each restaurant that are not among these dishes."""
    stirling = log_stirling(discount, EXACT)
    few, many = np.flatnonzero((count > 1) & (count <= EXACT)), np.flatnonzero(count > EXACT)
    tables, mean = tables.copy(), np.zeros(len(tables))
    for sweep in range(sweeps):
        rooms = others + np.bincount(left, tables, len(others)).astype(np.int64)
        rest = rooms[left] - tables
        tables[few] = draw_tables(rng, count[few], rest[few], parent[few], strength, discount, stirling)
        tables[many] = draw_many_tables(rng, count[many], rest[many], parent[many], strength, discount)
        if sweep >= burn:
            mean += tables / (sweeps - burn)
    return tables, mean


def _first_root(table: pa.Table) -> list[tuple]:
    """Number the words of a root shard, sum what is asked about them, one table each. The
    shards learn the numbers (and the training count) of their words once."""
    asks, shard = _by_kind(table)["ask"], table["to"][0].as_py()
    ids = [unpack(p[0], True) for _, p in asks]
    words = np.unique(np.concatenate(ids))
    places = [np.searchsorted(words, x) for x in ids]
    dish, context, tokens = (_summed(places, [p[k] for _, p in asks], len(words)) for k in (1, 2, 3))
    out = [(sender, shard, "words", [pack(at, True), pack(tokens[at].astype(np.int64))], None)
           for (sender, _), at in zip(asks, places)]
    tables = (dish > 0).astype(float)
    out += _answers(asks, places, shard, dish, tables, context, context)
    return [*out, _total(shard, tokens, dish, tables)]


def _root(table: pa.Table, totals: dict, epoch: int) -> list[tuple]:
    """Sum the tables of the shards and seat the root's customers."""
    asks, shard = _by_kind(table)["ask"], table["to"][0].as_py()
    places = [_int(p[0], True) for _, p in asks]
    size = max(int(x[-1]) for x in places) + 1
    dish, context, averaged = (_summed(places, [p[k] for _, p in asks], size) for k in (1, 2, 3))
    tables, rows = np.zeros(size), np.flatnonzero(dish)
    count = dish[rows].astype(np.int64)
    _, tables[rows] = gibbs(
        np.random.default_rng((SEED, epoch, shard, 1)), np.zeros(len(rows), np.int64), count,
        np.ones(len(rows), np.int64), np.array([max(0, int(totals["tables"]) - len(rows))]),
        np.full(len(rows), 1.0 / (totals["known"] + 1)), STRENGTH, totals["root_discount"],
        sweeps=BURN + DRAWS, burn=BURN)
    return [*_answers(asks, places, shard, dish, tables, context, averaged),
            _total(shard, np.zeros(0), dish, tables)]


def _summed(places: list, parts: list[bytes], size: int) -> np.ndarray:
    return np.bincount(np.concatenate(places), np.concatenate([unpack(p) for p in parts]).astype(float), size)


def _answers(asks, places, shard, dish, tables, context, averaged) -> list[tuple]:
    return [(sender, shard, "answer", [
        pack(dish[at].astype(np.int64)), pack(tables[at].astype(np.float32)),
        pack(context[at].astype(np.int64)), pack(averaged[at].astype(np.float32))], None)
        for (sender, _), at in zip(asks, places)]


def _total(shard, tokens, dish, tables) -> tuple:
    return -1, shard, "total", [], [float(x) for x in (
        (tokens > 0).sum(), tokens.sum(), dish.sum(), tables.sum(), (dish == 1).sum(), (dish == 2).sum())]


class Words:
    """A shard's words with the root's answers in place."""

    def __init__(self, kinds: dict, bounds: np.ndarray, totals: dict):
        self.spans, size = {r: slice(a, b) for r, a, b in _spans(bounds)}, int(bounds[-1])
        self.place, self.tokens = np.zeros(size, np.int64), np.zeros(size)
        dish, tables, self.context, self.averaged = (np.zeros(size) for _ in range(4))
        for sender, (place, tokens) in kinds["words"]:
            self.place[self.spans[sender]], self.tokens[self.spans[sender]] = _int(place, True), unpack(tokens)
        for sender, answer in kinds["answer"]:
            for column, part in zip((dish, tables, self.context, self.averaged), answer):
                column[self.spans[sender]] = unpack(part)
        d = totals["root_discount"]
        self.parent = (dish - d * tables + (STRENGTH + d * totals["tables"]) / (totals["known"] + 1)
                       ) / (STRENGTH + totals["customers"])


def _seats(kinds: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of the dishes with several customers: last drawn, and averaged."""
    if "seats" not in kinds:
        return np.ones(size, np.int64), np.ones(size)
    (_, (last, mean)), = kinds["seats"]
    return _int(last), unpack(mean).astype(float)


def _sit(table: pa.Table, totals: dict, epoch: int) -> list[tuple]:
    kinds = _by_kind(table)
    (shard, (left, right, count, dish, context, bounds)), = kinds["several"]
    left, right, count, bounds = _int(left, True), _int(right), _int(count), _int(bounds, True)
    dish, context = _int(dish), _int(context)
    words, (tables, _) = Words(kinds, bounds, totals), _seats(kinds, len(count))
    size = len(words.place)
    # Tables of a context that are not drawn here: other shards' and those of single customers.
    others = words.context.astype(np.int64) - np.bincount(left, tables, size).astype(np.int64)
    last, mean = gibbs(
        np.random.default_rng((SEED, epoch, shard, 0)), left, count, tables, np.maximum(others, 0),
        words.parent[right], STRENGTH, totals["discount"], sweeps=SWEEPS, burn=BURN)
    out = [(shard, shard, "seats", [pack(last), pack(mean.astype(np.float32))], None)]
    dish = dish + np.bincount(right, last, size).astype(np.int64)
    averaged = (context + np.bincount(left, mean, size)).astype(np.float32)
    context = context + np.bincount(left, last, size).astype(np.int64)
    for r, span in words.spans.items():
        out.append((r, shard, "ask", [pack(words.place[span], True), *(
            pack(x[span]) for x in (dish, context, averaged))], None))
    return out


# ---- 3. scores -----------------------------------------------------------------------------

def _score(table: pa.Table, totals: dict) -> list[tuple]:
    """Sums by document of each block: tokens, known tokens, base and model log10s."""
    kinds = _by_kind(table)
    (shard, (left, right, count, bounds)), = kinds["pairs"]
    left, right, count = _int(left, True), _int(right), _int(count)
    words = Words(kinds, _int(bounds, True), totals)
    several, tables = np.flatnonzero(count > 1), (count > 0).astype(float)
    tables[several] = _seats(kinds, len(several))[1]
    open_ = STRENGTH + totals["discount"] * words.averaged[left]
    value = np.log10((count - totals["discount"] * tables + open_ * words.parent[right])
                     / (STRENGTH + words.tokens[left]))
    tokens = words.tokens[right]
    base = np.log10((tokens + 0.5) / (totals["tokens"] + 0.5 * (totals["known"] + 1)))
    out = []
    for chunk, (pairs, times, docs) in kinds["tokens"]:
        at, docs = np.repeat(_int(pairs, True), _int(times)), _int(docs)
        n = np.bincount(docs)
        some = np.flatnonzero(n)
        sums = (n, np.bincount(docs, tokens[at] > 0).astype(np.int64), np.bincount(docs, base[at]),
                np.bincount(docs, value[at]).astype(np.float32))
        out.append((chunk, shard, "sums", [pack(some, True), *(pack(x[some]) for x in sums)], None))
    return out


_DOCS = pa.schema([("tag_chunk", pa.int64()), ("tag_doc", pa.int64()), ("doc_id", pa.int64()),
                   ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                   ("base_score", pa.float64()), ("score", pa.float64())])


def _gather(table: pa.Table) -> pa.Table:
    """One row for each document of a chunk."""
    kinds = _by_kind(table)
    (_, heads), = kinds["head"]
    ids, held, null, tag_chunk, tag_doc = (unpack(h) for h in heads)
    sums = [np.zeros(len(ids)) for _ in range(4)]
    for _, (docs, *parts) in kinds["sums"]:
        docs = _int(docs, True)
        for column, part in zip(sums, parts):
            column[docs] += unpack(part)
    return pa.Table.from_arrays([
        pa.array(tag_chunk.astype(np.int64)), pa.array(tag_doc.astype(np.int64)),
        pa.array(ids.view(np.int64), mask=null > 0), pa.array(held > 0),
        *(pa.array(s.astype(np.int64)) for s in sums[:2]), *(pa.array(s) for s in sums[2:])], schema=_DOCS)


def _exchange(parcels: DataFrame, work, name: str) -> DataFrame:
    """One pass over all parcels, written. Spark removes the files of a finished shuffle only
    once the driver has collected its garbage, so that is asked for."""
    done = materialise(parcels.groupBy("to").applyInArrow(
        lambda table: _given_back(_parcels(work(table))), _PARCEL), f"py-{name}")
    parcels.sparkSession.sparkContext._jvm.System.gc()
    return done


def _totals(answers: DataFrame, before: dict) -> dict:
    """Sums over the root's shards: one row reaches the driver."""
    names = ("known", "tokens", "customers", "tables", "ones", "twos")
    row = answers.where("kind = 'total'").agg(*[
        F.coalesce(F.sum(F.col("sums")[k]), F.lit(0.0)).alias(n) for k, n in enumerate(names)]).first()
    if not before:
        return row.asDict() | {"root_discount": discount_of(row.ones, row.twos)}
    return before | {"customers": row.customers, "tables": row.tables}


def discount_of(ones: float, twos: float) -> float:
    """From how many dishes have one customer and two."""
    return min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5


def frequent_words(docs: DataFrame, shards: int) -> np.ndarray:
    """Hashes of words with a quarter of a shard's fair share of a sample (2 % of the texts,
    by hash) or more: at most 4 x shards. They only decide how pairs are dealt."""
    words = docs.where(F.pmod(F.xxhash64("text"), F.lit(50)) == 0).select(F.explode(F.regexp_extract_all(
        F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        F.lit(r"([^\x20\x09-\x0D]+)"))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    least = F.col("n") * 4 * shards >= counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    found = [word_hashes(r.word.encode())[2] for r in counts.where(least).collect()]
    return np.concatenate([[END], *found]).astype(np.uint64)


def score_documents(docs: DataFrame, chunk: int = CHUNK, shard: int = SHARD,
                    epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    held = F.crc32(F.col("doc_id").cast("string")) % HELD_PARTS == HELD
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(held, F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard))
    hot = frequent_words(rows, shards)

    def chunks(batches):
        held = []
        for row in _chunks(batches, hot, shards, chunk):
            held.append(row)
            if len(held) >= 32:
                yield from _parcels(held).to_batches()
                held = []
        if held:
            yield from _given_back(_parcels(held)).to_batches()

    with batches_up_to(spark, BATCH):
        state = _exchange(rows.mapInArrow(chunks, _PARCEL), lambda t: _merge(t, shards), "pairs")

    def of(parcels: DataFrame, kind: str) -> DataFrame:
        return parcels.where(F.col("kind") == kind)

    several, seats = of(state, "several"), None
    ones, twos = several.agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0.0)) for k in (0, 1)]).first()
    answers = _exchange(of(state, "ask"), _first_root, "root-0")
    totals = _totals(answers, {}) | {"discount": discount_of(ones, twos)}
    words = of(answers, "words")
    for epoch in range(1, epochs + 1):
        known = several.unionAll(words).unionAll(of(answers, "answer"))
        known = known if seats is None else known.unionAll(seats)
        sat = _exchange(known, lambda t, now=totals, e=epoch: _sit(t, now, e), f"seats-{epoch}")
        seats = of(sat, "seats")
        answers = _exchange(of(sat, "ask"), lambda t, now=totals, e=epoch: _root(t, now, e), f"root-{epoch}")
        totals = _totals(answers, totals)
    everything = of(state, "pairs").unionAll(of(state, "tokens")).unionAll(words).unionAll(of(answers, "answer"))
    everything = everything if seats is None else everything.unionAll(seats)
    sums = everything.groupBy("to").applyInArrow(lambda t: _given_back(_parcels(_score(t, totals))), _PARCEL)
    per_chunk = sums.unionAll(state.where("kind = 'head'")).groupBy("to").applyInArrow(
        _gather, "tag_chunk bigint, tag_doc bigint, doc_id bigint, held_out boolean, n_tokens bigint, "
        "n_known bigint, base_score double, score double")
    whole = ("n_tokens", "n_known", "base_score", "score")
    return per_chunk.groupBy("tag_chunk", "tag_doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"),
        *[F.sum(c).alias(c) for c in whole]).select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(int(totals["tokens"])).cast("bigint").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame, column: str = "score") -> DataFrame:
    """Perplexity of the held-out and of the training rows, by all their tokens."""
    return scored.groupBy("held_out").agg(
        F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens")).alias("perplexity"))
