"""Merkle manifest, conversation repair and Pitman-Yor scores against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stagecraft.llm import merkle, pitman_yor, turn_repair

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, size string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_manifest(rows):
    by = {}
    for r in rows:
        cut = r.text
        if r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
            cut = r.text.replace("\n", "")
        whole = [framed(r[c]) for c in merkle.FIELDS[:-1]]
        by.setdefault(r.source, []).append((r.doc_id, sha(*whole, framed(r.text)), sha(*whole, framed(cut))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: levels([x[1] for x in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, (doc_id, leaf, node) in enumerate(by[s]):
            siblings = []
            for tree, at in ((trees[s], i), (top, j)):
                for nodes in tree[:-1]:
                    low, inside = at // 3 * 3, at % 3
                    run = nodes[low:low + 3]
                    siblings += run[:inside] + run[inside + 1:]
                    node, at = sha(*run[:inside], node, *run[inside + 1:]), at // 3
            root = top[-1][0]
            out.append((doc_id, leaf, trees[s][-1][0], root, sha(*siblings), node, node == root))
    return out


@pytest.mark.parametrize("depth", [2, 6])
def test_manifest_matches_brute_force(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rows = [(i * 37 % 1009, f"t{i}\nx", "en", "s" if i % 3 else None, i, "x", "y") for i in range(200)]
    rows += [(5, "same\n", "en", "s", 1, "x", "y")] * 30 + [(7, f"z{i}", None, "s", 2, "x", "y") for i in range(30)]
    rows += [(None, "q", "e", "s", 1, "x", "y")] * 3 + [(None,) * 7] * 2 + [(1, "only", "e", "solo", 2, "x", "y")]
    rows += [(i, "b\n", "e", "é", 1, "x", "y") for i in (-5, -(1 << 63), (1 << 63) - 1)] + [(63, "a", "", "", 1, "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted([tuple(r) for r in merkle.manifest(docs).collect()], key=repr)
    assert got == sorted(brute_manifest(docs.collect()), key=repr)
    assert {r[0] for r in got if not r[-1]} and merkle.manifest(docs.limit(0)).count() == 0


def test_a_lone_document_is_its_own_root(spark):
    (row,) = merkle.manifest(spark.createDataFrame([(2, None, None, None, None, "", "")], DOCS)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof_sha256 == hashlib.sha256(b"").hexdigest()


# ---- conversations -------------------------------------------------------------------------

NEXT = {"u": (2, 2, None, 2), "a": (None, None, 3, None), "s": (1, None, None, None)}
FREE, NAMES = (2, 2, 3, 2), {2: "user", 3: "assistant"}


def damaged(rows):
    def text(value):
        return " " if value is None else str(value)

    for conv, turn, role, said in rows:
        drawn = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, said = "user" if drawn == 4 else text(role), text(said)
        said = "" if drawn == 1 else re.sub("[.!?]", "", said) if drawn == 2 else said
        if drawn:
            yield from [(turn, role, said)] * (2 if drawn == 3 else 1)


def cheapest(rows, faults):
    """Ways in order of (cost, audit) until one is whole: the first is the answer."""
    heap = [(0, "", 0, 0, ())]
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, lines
        if not audit.endswith("II"):
            to = FREE[state]
            heapq.heappush(heap, (cost + 3, audit + "I", at, to, (*lines, NAMES[to] + ":")))
        if at < len(rows):
            _, role, said = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, lines))
            if faults[at] not in ("blank", "duplicate"):
                more, to = 3 if faults[at] else 0, FREE[state]
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, to, (*lines, f"{NAMES[to]}:{said}")))
                kept = NEXT.get(role[:1], (None,) * 4)[state]
                if kept is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, kept, (*lines, f"{role}:{said}")))


def brute_repair(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = []
    for conv, own in by.items():
        after = sorted(damaged(own), key=lambda r: (
            r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, said in after:
            bare = re.sub(r"[\x20\x09-\x0D]", "", said)
            faults.append("blank" if not bare else "duplicate" if (role, said) in seen
                          else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, said))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        turns = {t for t, _, _ in after if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, lines = cheapest(after, faults)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost,
                    audit, sha("\n".join(lines))))
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "k", "m") for r in rows], (
        "conv_id bigint, turn bigint, role string, text string, kind string, syms string"))


@pytest.mark.parametrize("piece", [2, 4096])
def test_repairs_match_a_best_first_search(spark, monkeypatch, piece):
    monkeypatch.setattr(turn_repair, "PIECE", piece)
    draw, rows = random.Random(1), []
    for conv in [*range(50), None]:
        for turn in range(draw.randrange(1, 8)):
            rows.append((conv, draw.choice([turn, turn, turn, None, turn + 1]),
                         draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                         draw.choice(["Hi.", "a b", "What?", "", " \t", None, f"x{draw.randrange(9)}.", "é!"])))
    rows += [(7, 2, "user", "Hi.")] * 3
    table = conversations(spark, rows)
    want = sorted(brute_repair(rows), key=repr)
    assert sorted([tuple(r) for r in turn_repair.repair(table).collect()], key=repr) == want
    lines = {}
    for r in sorted(turn_repair.repaired_turns(table).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(sha("\n".join(lines.get(w[0], []))) == w[-1] for w in want)
    assert turn_repair.repair(table.limit(0)).count() == 0


def test_a_long_conversation_is_the_product_of_its_parts(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(1, t, draw.choice(["user", "assistant"]), f"w{draw.randrange(40)}.") for t in range(120)]
    whole = turn_repair.repair(conversations(spark, rows)).collect()
    monkeypatch.setattr(turn_repair, "PIECE", 16)
    assert turn_repair.repair(conversations(spark, rows)).collect() == whole
    assert len(whole[0].audit.replace("I", "")) == whole[0].duplicate + sum(
        r is not None for r in turn_repair.symbols(turn_repair.damage(conversations(spark, rows))).where("not dup").collect())


def test_rule_matrices_are_products_of_their_parts():
    rules = [("", "u", "a"), ("", "", ""), ("", "x", "")]
    known = turn_repair.rule_matrices(rules)

    def flat(matrix):
        return [[c and (c[0], c[1].text()) for c in row] for row in matrix]

    assert flat(turn_repair.string_matrix("U", known)) == flat(turn_repair.string_matrix("xuauaU", known))
    assert known[""][0][3][0] == 4 and known[""][0][3][1].text() == "DKKKK"


# ---- language model ------------------------------------------------------------------------

def brute_base(rows):
    tokens = []
    for doc_id, text in rows:
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        tokens.append((doc_id, held, [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]))
    count = Counter(t for _, held, words in tokens if not held for t in words)
    n, v = sum(count.values()), len(count)
    return [(i, held, len(words), sum(t in count for t in words), n,
             round(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in words), 6))
            for i, held, words in tokens]


def text(seed, n):
    """Each word is mostly told by the one before."""
    draw, words, at = np.random.default_rng(seed), [], 0
    for _ in range(n):
        at = (at * 7 + 3) % 50 if draw.random() < 0.8 else int(draw.integers(0, 50))
        words.append(f"W{at}" if draw.random() < 0.5 else f"w{at}")
    return " ".join(words)


def test_scores_of_whole_documents(spark):
    rows = [(i, text(i, 40 + i % 30)) for i in range(150)]
    rows += [(None, "w1 w2"), (None, None), (900, ""), (901, " \n\t"), (3, rows[3][1]), (902, "new words é ß")]
    docs = spark.createDataFrame([(*r, "en", "s", 0, "x", 1.0) for r in rows], (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, parts string, score double"))
    got = pitman_yor.score_documents(docs, chunk=3000, shard=6000).collect()
    base = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(base, key=repr) == sorted(brute_base(rows), key=repr)
    held = [r for r in got if r.held_out and r.n_tokens > 30]
    # Four of five words follow from the one before, which words alone cannot tell.
    assert sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held) and len(held) > 15
    assert all(r.score < 0 for r in got)
    assert pitman_yor.score_documents(docs.limit(0)).count() == 0


def test_a_long_document_may_fill_several_chunks(spark, monkeypatch):
    rows = [(i, text(i, 300)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    whole = {r.doc_id: r for r in pitman_yor.score_documents(docs, epochs=1).collect()}
    monkeypatch.setattr(pitman_yor, "PIECE", 70)
    for r in pitman_yor.score_documents(docs, chunk=500, epochs=1).collect():
        assert (r.n_tokens, r.n_known) == (whole[r.doc_id].n_tokens, whole[r.doc_id].n_known)
        assert abs(r.base_score - whole[r.doc_id].base_score) < 1e-6 and abs(r.score / whole[r.doc_id].score - 1) < 1e-3


def test_only_unknown_words_without_training_rows(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = pitman_yor.score_documents(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def partitions(n):
    """Table sizes of every way to seat n customers one after another."""
    if n == 1:
        return [(1,)]
    out = []
    for sizes in partitions(n - 1):
        out += [(*sizes[:k], sizes[k] + 1, *sizes[k + 1:]) for k in range(len(sizes))] + [(*sizes, 1)]
    return out


def test_stirling_numbers_and_the_conditional_of_tables():
    d, strength, others, parent, c = 0.4, 1.5, 3, 0.2, 5
    weight = Counter()
    for sizes in partitions(c):
        weight[len(sizes)] += math.prod(math.prod(k - d for k in range(1, s)) for s in sizes)
    table = pitman_yor.log_stirling(d, 8)
    assert np.allclose([math.exp(table[c, t]) for t in range(1, c + 1)], [weight[t] for t in range(1, c + 1)])
    want = np.array([weight[t] * parent**t * math.prod(strength + d * (others + j) for j in range(t))
                     for t in range(1, c + 1)])
    rng, n = np.random.default_rng(0), 40_000
    got = pitman_yor.draw_tables(rng, np.full(n, c), np.full(n, others), np.full(n, parent), strength, d, table)
    assert np.allclose(np.bincount(got, minlength=c + 1)[1:] / n, want / want.sum(), atol=0.01)
    # Moving customers one at a time keeps to the same distribution.
    sizes, seen = pitman_yor.arrive(rng, c, others, parent, strength, d), Counter()
    for _ in range(40_000):
        sizes = pitman_yor.move(rng, sizes, others, parent, strength, d)
        seen[len(sizes)] += 1
    assert sizes.sum() == c
    assert np.allclose([seen[t] / 40_000 for t in range(1, c + 1)], want / want.sum(), atol=0.03)


def test_packed_numbers_come_back():
    for values in (np.array([], np.uint64), np.array([3, 3, 900, 1 << 63], np.uint64), np.arange(5)):
        assert pitman_yor.unpack(pitman_yor.pack(values)).tolist() == values.tolist()
        assert pitman_yor.unpack(pitman_yor.pack(values, True), True).tolist() == values.tolist()
    floats = np.array([0.5, -2.25], np.float32)
    assert pitman_yor.unpack(pitman_yor.pack(floats)).tolist() == floats.tolist()
