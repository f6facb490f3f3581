"""The dealt operators against brute force on small fixtures and edge cases."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from stagecraft.llm import (
    bm25_decon, ecoc_lang, fm_dedup, line_blocks, mixture, ngram_join, pii_crf, syncmers,
    url_vocab, warc_revisit)
from stagecraft.operators import skew
from stagecraft.llm.words import code_points, mix, sliding_min, word_hashes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string"


def make(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang, source); ``node`` clashes."""
    full = [(*r, "en", "a")[:4] if len(r) == 2 else r for r in rows]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x") for i, t, lang, s in full], SCHEMA)


def prose(seed, n, vocabulary=400):
    draw = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in draw.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(1, 30_000)
    return make(spark, [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "A b"), (6, long), (6, long),
                        (7, prose(2, 60)), (8, prose(2, 60)), (None, prose(2, 60)), (9, "éß 漢字 \U0001f600")])


def test_words_split_on_ascii_white_space_and_hash_by_content():
    data = "a\u00a0b  a\u00a0b\x0bc\x1cd".encode()
    starts, ends, hashes = word_hashes(data)
    assert [data[a:b] for a, b in zip(starts, ends)] == data.split()
    assert hashes[0] == hashes[1] != hashes[2]
    values = np.random.default_rng(0).integers(0, 99, 50)
    assert sliding_min(values, 7).tolist() == [min(values[i:i + 7]) for i in range(44)]


def test_syncmers_match_their_definition():
    text = prose(3, 80)
    codes, k, s = code_points(text), 12, 5
    at, _ = syncmers.anchors(codes, k, s)
    from stagecraft.llm.words import gram_hashes
    inner = gram_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), s)
    want = [i for i in range(len(codes) - k + 1)
            if min(inner[i:i + 8]) in (inner[i], inner[i + 7])]
    assert at.tolist() == want
    moved, _ = syncmers.anchors(code_points("zz " + text), k, s)
    assert set(at + 3) <= set(moved)


def test_fingerprints_follow_the_next_document(spark, odd):
    rows = sorted(syncmers.fingerprints(odd).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    texts = [t or "" for t in (None, "", " \n\t", "a", "A b", prose(1, 30_000), prose(1, 30_000),
                               prose(2, 60), prose(2, 60), "éß 漢字 \U0001f600", prose(2, 60))]
    assert [r.n_chars for r in rows] == [len(t) for t in texts]
    for i, row in enumerate(rows):
        want = syncmers.edited(texts[i], texts[(i + 1) % len(texts)])
        assert row.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert rows[7].near_next == rows[0].near_next == 1.0
    assert rows[7].fingerprint == rows[8].fingerprint and 0.3 < rows[6].near_edited < 0.9
    assert syncmers.fingerprints(odd.limit(0)).count() == 0


def likeness_by_definition(a, b, kept=64):
    """Likeness from all anchors: the common ones among the smallest, longest chain in order."""
    def first_places(text):
        out = {}
        for p, h in zip(*(x.tolist() for x in syncmers.anchors(code_points(text)))):
            out.setdefault(h >> 32, p)
        return out

    x, y = first_places(a), first_places(b)
    least = set(sorted(x)[:kept]) | set(sorted(y)[:kept])
    least = set(sorted(least)[:kept])
    both = sorted((h for h in least if h in x and h in y), key=x.get)
    best = [0] * len(both)
    for i, h in enumerate(both):
        best[i] = 1 + max((best[j] for j in range(i) if y[both[j]] < y[h]), default=0)
    return max(best, default=0) / len(least)


def test_likeness_follows_the_order_of_anchors(spark):
    texts = [prose(s, n, 3000) for s, n in ((40, 300), (41, 50), (42, 2000), (43, 12))]
    a = texts[0]
    texts += [a, a[900:] + " " + a[:900], a.replace("w1", "v1"), a + " " + a]
    docs = make(spark, list(enumerate(texts)))
    rows = sorted(syncmers.fingerprints(docs).collect(), key=lambda r: r.doc_id)
    marks = [syncmers.fingerprint(t) for t in texts]
    for i, row in enumerate(rows):
        after = texts[(i + 1) % len(texts)]
        assert row.near_next == likeness_by_definition(texts[i], after)
        assert row.near_edited == likeness_by_definition(texts[i], syncmers.edited(texts[i], after))
        assert row.fingerprint == syncmers.as_text(marks[i])
    swapped = syncmers.likeness(marks[0], marks[5])
    assert 0.3 < swapped < 0.8 and syncmers.likeness(marks[0], marks[4]) == 1.0
    got = {(r.doc_id, r.position) for r in syncmers.syncmer_anchors(docs).collect()}
    assert got == {(i, p) for i, t in enumerate(texts) for p in syncmers.anchors(code_points(t))[0].tolist()}


def largest_to_median(df):
    sizes = sorted(df.rdd.glom().map(len).collect())
    return sizes[-1] / sizes[len(sizes) // 2]


def test_rows_without_an_id_are_dealt_to_many_tasks(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, prose(i, 9, 5000)) for i in range(3000)]
    dealt = syncmers.with_next(make(spark, rows))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt.count() <= 3000 + parts
    by_part = sorted(r["count"] for r in dealt.groupBy("part").count().collect())
    assert len(by_part) == parts and by_part[-1] <= 4 * by_part[len(by_part) // 2]
    got = Counter((r.doc_id, r.n_chars) for r in syncmers.fingerprints(make(spark, rows)).collect())
    assert got == Counter((i, len(t)) for i, t in rows)


def brute_removed(texts, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1
                for j in range(i, i + window)}
        out.append(" ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("hot", [5000, 0])
def test_repeated_passages_match_brute_force(spark, hot):
    shared, other = prose(4, 50), prose(5, 40)
    texts = [None, "", "x " * 100, prose(6, 300), prose(7, 20) + " " + shared + " " + prose(8, 30),
             shared + " tail", prose(9, 90) + " " + shared, " ".join(shared.split()[:35]), other, other,
             other + " z " + other[:-4], " ".join(prose(10, 34).split()), prose(11, 90) + " " + prose(11, 90)]
    docs = make(spark, list(enumerate(texts)))
    rows = {r.doc_id: r for r in fm_dedup.remove_repeats(docs, shard_words=100, hot=hot).collect()}
    assert [rows[i].kept for i in range(len(texts))] == brute_removed(texts)
    assert fm_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_a_passage_in_many_documents_reaches_its_shard_twice(spark, monkeypatch):
    sent, search = [], fm_dedup.search_shards

    def seen(words, window):
        rows = words.collect()
        sent.extend(tuple(r.words) for r in rows)
        shards.extend(Counter(r.shard for r in rows).values())
        return search(words, window)

    shards = []
    monkeypatch.setattr(fm_dedup, "search_shards", seen)
    shared = prose(12, 50)
    texts = [f"{prose(500 + i, 40)} {shared} {prose(600 + i, 40)}" for i in range(20)]
    rows = [*enumerate(texts), (3, texts[3])]
    out = fm_dedup.remove_repeats(make(spark, rows), shard_words=400, hot=5).collect()
    assert sorted(r.kept for r in out) == sorted(brute_removed([t for _, t in rows]))
    windows = Counter(w for s in sent for w in zip(*(s[k:] for k in range(35))))
    assert max(windows.values()) == 2 and max(shards) <= 40


def test_repeated_rows_are_repeated_passages(spark, odd):
    rows = fm_dedup.remove_repeats(odd).collect()
    assert {r.n_removed for r in rows if r.doc_id == 6} == {30_000} and len(rows) == 11
    assert {r.n_removed for r in rows if r.doc_id in (7, 8, None)} == {60}


def test_wavelet_ranks():
    symbols = np.random.default_rng(0).integers(0, 9, 300)
    matrix = fm_dedup.WaveletMatrix(symbols)
    for s in range(9):
        base = matrix.place(np.array([s]), np.array([0]))[0]
        assert [matrix.place(np.array([s]), np.array([i]))[0] - base for i in (1, 64, 299, 300)] == [
            (symbols[:i] == s).sum() for i in (1, 64, 299, 300)]


def test_base_spans_match_the_patterns():
    text = ("a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111-1111 1111 4111111111111112 "
            "+1 (377) 555-0271. +12 @x.y .@. a@b " + "9" * 30)
    want = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                          ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (
                    kind == "card" and 13 <= len(digits) <= 19 and pii_crf.luhn(digits)) or (
                    kind == "phone" and 9 <= len(digits) <= 15):
                want.append((kind, m.start(), m.end()))
    assert pii_crf.base_spans(text) == want


@pytest.fixture(scope="module")
def field():
    return pii_crf.train()


def test_field_adds_what_patterns_miss_and_spares_clean_text(spark, odd, field):
    found = pii_crf.find_all(["call (377) 555-0271 now", "in 1999 version 2.0 of 12 or 9c8b45435718dcc700",
                              None, "card 1234567812345678 is false"], field)
    assert [s[0] for s in found[0][1]] == ["phone"] and found[1] == found[2] == ([], []) and not found[3][1]
    assert pii_crf.find(odd, field).count() == 11
    masked = pii_crf.mask(make(spark, [(1, "to a@b.cd!"), (2, None)]), field).collect()
    assert [r.text for r in masked] == ["to <EMAIL>!", None] and masked[0].node == "x"


def test_viterbi_is_the_best_path(field):
    chain = pii_crf.features(["+1", "(377)", "555-0271"], ["call"])
    emit, n = field.scores(chain), len(pii_crf.LABELS)
    paths = {(a, b, c): emit[0, a] + field.move[-1, a] + field.move[a, b] + emit[1, b]
             + field.move[b, c] + emit[2, c] for a in range(n) for b in range(n) for c in range(n)}
    assert tuple(field.decode([chain])[0]) == max(paths, key=paths.get)


def test_languages_held_out(spark, odd):
    rows = [(i, prose(i, 50).replace("w", "th" if i % 2 else "qu"), "en" if i % 2 else "fr", "s")
            for i in range(120)]
    docs = make(spark, rows)
    model = ecoc_lang.fit(ecoc_lang.learnable(docs))
    out = ecoc_lang.identify(docs, model).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "fr") and 0 <= r.score <= 1 for r in out)
    assert any(r.held_out for r in out)
    judged = {r.doc_id: r for r in ecoc_lang.identify(odd, model).collect()}
    assert judged[1].lang_pred == judged[2].lang_pred == "und" and judged[1].score == 0.0
    nothing = ecoc_lang.fit(docs.limit(0))
    assert ecoc_lang.identify(odd, nothing).where("lang_pred <> 'und'").count() == 0
    assert ecoc_lang.keep_identified(odd, model).columns == odd.columns


def test_main_text_of_pages():
    page = ("<html><head><title>T</title></head><nav><ul><li>Menu</ul></nav><div class='ad'>Buy</div>"
            "<article><h1>A &amp; B</h1><p><b>One<br>two <p>Three&nbsp;x <aside>no</aside><p>Four"
            "<div id=comments><p>hi</p></div><form>q</form></article><footer>&copy;</footer>")
    assert line_blocks.main_text(page) == "A & B\n\nOne two\n\nThree x\n\nFour"
    assert line_blocks.main_text(None) == line_blocks.main_text("<script>x</script>") == ""
    plain = "<div class=menu>m</div>" + "<p>word word word word</p>" * 3
    assert line_blocks.main_text(plain) == "\n\n".join(["word word word word"] * 3)


@pytest.mark.parametrize("page, want", [
    ("<div><p>story</p></div><section class=comments><article>reader comment</article></section>", ["story"]),
    ("<div><p>story</p></div><aside><article>one</article><article>two</article></aside>", ["story"]),
    ("<p>" + "long " * 200 + "</p>" + "<div class=ad>Buy</div>" * 3 + "<p>The end.</p>",
     ["long " * 199 + "long", "The end."]),
    ("<div class=with-sidebar><article>story</article></div>", ["story"]),
    ("<div class='layout has-comments no-ads'><p>story</p></div><div class=ads>x</div>", ["story"]),
    ("<div id=content-sidebar-wrap><main>story</main><div class=sidebar>x</div></div><p>" + "y" * 99, ["story"]),
    ("<div class=header-wrap><p>a long story</p></div><p>end</p>", ["a long story", "end"]),
    ("<p>a long story</p><div class=comments-wrap><article>reader</article></div>", ["a long story"]),
    ("<p>a long story</p><div class='ads no-print'>x", ["a long story"])])
def test_pages_keep_their_main_text(page, want):
    assert line_blocks.main_text(page) == "\n\n".join(want)


STORY = ["The story goes on and on for a while.", "Short.", "It has a second part that is longer."]
MENU = "<ul><li>Home</li><li>About</li><li>News</li></ul>"
LINKS = "<div><a href=a>One more</a></div><div><a href=b>Two more</a></div><div><a href=c>Three more</a></div>"


def told(*between):
    parts = [f"<p>{t}</p>" for t in STORY]
    return parts[0] + "".join(between) + parts[1] + parts[2]


@pytest.mark.parametrize("page, want", [
    (MENU + told() + LINKS, STORY),
    (LINKS + MENU + "<h1>Title</h1>" + told() + "<h4>Elsewhere</h4>" + LINKS + MENU, ["Title", *STORY]),
    (told(LINKS), STORY),
    (told("<ul><li>one</li><li>two</li></ul>"), [STORY[0], "one", "two", *STORY[1:]]),
    (told("<div><a href=x>see here</a></div>"), [STORY[0], "see here", *STORY[1:]]),
    (LINKS, []), ("<article>" + LINKS + "</article>" + told(), ["One more", "Two more", "Three more"])])
def test_surge_and_dive_decide_without_names(page, want):
    assert line_blocks.main_text(page) == "\n\n".join(want)


def test_the_window_decides_what_stays():
    page = told(LINKS)
    assert "Two more" in line_blocks.main_text(page, window=7)
    far = MENU + LINKS + told()
    assert "Home" in line_blocks.main_text(far, share=0.0)
    weights = np.random.default_rng(5).integers(0, 40, 60)
    for window in (1, 2, 3, 6):
        before = (window - 1) // 2
        assert line_blocks.window_sums(weights, window).tolist() == [
            sum(weights[max(i - before, 0):max(i - before + window, 0)]) for i in range(60)]


def test_deep_and_broken_markup_takes_linear_time():
    start = time.process_time()
    for page in ("<div>" * 20_000 + "x", "<b>" * 20_000 + "</i>" * 20_000, "<p><b>" * 20_000):
        line_blocks.main_text(page)
    assert time.process_time() - start < 5


def test_pages_of_every_kind_are_extracted(spark):
    long = "<p>" + "word " * 200_000 + "</p>"
    rows = [(1, "u", None), (2, None, ""), (None, None, "<p>a b</p>"), (None, None, "<p>a b</p>"),
            (3, "u", long)]
    wide = pages(spark, rows).selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = sorted(((r.page_id, r.text[:9], r.n_chars) for r in line_blocks.extract(wide).collect()), key=str)
    assert got == sorted([(1, "", 0), (2, "", 0), (None, "a b", 3), (None, "a b", 3), (3, "word word", 999_999)], key=str)
    assert line_blocks.extract(pages(spark, [])).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_archives_round_trip(spark, tmp_path):
    big = "<p>é" + "x" * 1000
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None),
            (6, "u", big + "\r\n\r\nWARC/1.1"), (None, "u", big), (2, "w", big)]
    warc_revisit.write_archives(pages(spark, rows), str(tmp_path / "w"), records_per_file=2)
    out = warc_revisit.read_archives(spark, str(tmp_path / "w")).collect()
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    want = sorted((i or 0, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(),
                   "revisit" if i in (1, None) else "response", 2 if i in (1, None) else None)
                  for i, _, h in rows)
    assert got == want


def test_benchmark_items_are_found(spark, odd):
    items = [prose(s, 40, 3000) for s in range(20, 32)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id bigint, text string")
    texts = [prose(50, 200, 3000) + " " + items[3].upper() + " " + prose(51, 90, 3000), items[4], None,
             prose(52, 500, 3000), " ".join(items[5].split()[:15])]
    docs = make(spark, list(enumerate(texts)))
    got = {(r.doc_id, r.item_id) for r in bm25_decon.contaminated(docs, bench).collect()}
    assert got == {(0, 3), (1, 4)}
    kept = bm25_decon.drop_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4} and kept.columns == docs.columns
    assert bm25_decon.contaminated(odd, bench.limit(0)).count() == 0


def test_block_bounds_lose_no_item():
    items = [(i, prose(s, 30, 200)) for i, s in enumerate(range(60, 100))]
    words = [(i, t, t.split()) for i, t in items]
    df = Counter(w for _, _, ws in words for w in set(ws))
    index = bm25_decon.build([(i, t, w, [df[x] for x in w]) for i, t, w in words], 40, 30.0)
    text = prose(200, 300, 200).split()
    got = {(i.item_id, start) for i, _, start in index.search(text, 0.3)}
    names = list(index.vocabulary)
    want = set()
    for start in range(0, len(text), index.stride):
        have = set(text[start:start + 2 * index.stride])
        for k, item in enumerate(index.items):
            if sum(w for t, w in zip(names, index.weights[k]) if t in have) >= 0.3:
                want.add((item.item_id, start))
    assert {x for x in want if x[1] + index.stride < len(text)} <= got <= want


@pytest.mark.parametrize("at_once", [1, 3, 256])
@pytest.mark.parametrize("least", [0.15, 0.3, 0.6, 1.0])
def test_pivots_find_what_exact_scores_find(at_once, least, monkeypatch):
    monkeypatch.setattr(bm25_decon, "AT_ONCE", at_once)
    items = [(i, f"q{i}?", prose(500 + i, 5 + i % 40, 150).split()) for i in range(90)] + [(90, "one", ["w1"])]
    df = Counter(w for _, _, ws in items for w in set(ws))
    index = bm25_decon.build([(i, t, w, [df[x] for x in w]) for i, t, w in items], len(items), 25.0)
    text = prose(600, 500, 300).split() + items[40][2] + prose(601, 211, 300).split() + items[89][2]
    terms = {t: k for t, k in index.vocabulary.items()}
    want = {}
    for start in range(0, len(text), index.stride):
        have = [terms[t] for t in set(text[start:start + 2 * index.stride]) if t in terms]
        for item, share in zip(index.items, index.weights[:, have].sum(axis=1)):
            if share >= least - 1e-6:
                want[item.item_id, start] = share
    got = {(item.item_id, start): share for item, share, start in index.search(text, least)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {40, 89} <= {i for i, _ in got}
    whole = index.entries
    assert all((np.diff(whole.places[a:b]) > 0).all() for a, b in zip(whole.ends[:-1], whole.ends[1:]))


def test_several_indexes_are_asked_in_one_pass(spark, monkeypatch):
    rows = [(i, prose(700 + i, 30, 900)) for i in range(40)]
    bench = spark.createDataFrame(rows, "item_id bigint, text string")
    docs = make(spark, [(i, prose(800 + i, 80, 900) + " " + rows[i][1] + " " + prose(900 + i, 20, 900))
                        for i in range(0, 40, 3)] + [(99, prose(999, 300, 900)), (100, None)])
    want = {(i, i) for i in range(0, 40, 3)}
    for per_index, per_pass in ((512, 128), (7, 128), (7, 2)):
        monkeypatch.setattr(bm25_decon, "PER_PASS", per_pass)
        monkeypatch.setattr(bm25_decon.indexes, "__defaults__", (per_index,))
        assert {(r.doc_id, r.item_id) for r in bm25_decon.contaminated(docs, bench).collect()} == want
        assert {r.doc_id for r in bm25_decon.drop_contaminated(docs, bench).collect()} == {99, 100}


def test_mixture(spark, odd):
    docs = make(spark, [(i, prose(i, 40 + i % 50), "en", None if i % 7 == 0 else "abcd"[i % 4])
                        for i in range(400)])
    out = mixture.mix(docs, block=16).collect()
    again = {r.doc_id: r.taken for r in mixture.mix(docs.repartition(5), block=16).collect()}
    assert again == {r.doc_id: r.taken for r in out}
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 64 and r.source_size == sizes[r.source] for s in sizes)
    blocks = mixture.mixed_blocks(docs, block=16).collect()
    assert sum(len(b.text.split()) for b in blocks) == sum(taken.values())
    assert len({(b.shard, b.place) for b in blocks}) == len(blocks)
    assert sum(r.taken for r in mixture.mix(odd).collect() if r.size == 0) == 0
    assert mixture.mix(docs.limit(0)).count() == 0


def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixture.targets(sizes).collect()}
    assert got["a"] == 30.0 and got[None] == 0.0 and abs(got["b"] / got["c"] - 2) < 1e-9


def test_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F
    for n in (1, 2, 97, 1000):
        got = spark.range(n).select(mixture.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(5)).alias("p"))
        assert sorted(r.p for r in got.collect()) == list(range(n))


def test_a_payload_of_a_third_of_all_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    body = "z" * 1200
    rows = [(i, f"http://h/{i}", body if i % 3 == 0 else f"{i} " * 400) for i in range(900)]
    rows += [(900 + i, "u", f"{i % 50} " * 500) for i in range(300)]
    docs = pages(spark, rows).selectExpr("*", "'x' AS digest", "1L AS holder", "2L AS bytes", "'y' AS payload")
    known = warc_revisit.resolve(docs)
    assert {r.page_id: r.holder for r in known.collect()} == {
        i: 897 if i < 900 else 1150 + i % 50 for i, _, t in rows if i >= 900 or i % 3 == 0}
    # Hot keys are answered from a broadcast, then dealt by page: no exchange holds the digest alone.
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and largest_to_median(known) < 4
    warc_revisit.write_archives(docs, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc_revisit.read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(got) == 1200 and got[3].refers_to == 897 and got[897].refers_to is None
    assert got[1].record_type == "response" and got[901].refers_to == 1151
    warc_revisit.write_archives(docs.limit(0), str(tmp_path / "none"))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_join_matches_brute_force(spark, n, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 7)
    draw, rows = np.random.default_rng(1), []
    for base in range(12):
        words = prose(base + 300, int(draw.integers(4, 120))).split()
        for _ in range(8):
            edited = list(words)
            for _ in range(int(draw.integers(0, 4))):
                edited[int(draw.integers(0, len(edited)))] = f"e{draw.integers(0, 9)}"
            rows.append((len(rows), " ".join(edited).upper() if draw.integers(0, 2) else " ".join(edited)))
    rows += [(500, None), (501, ""), (502, "a"), (503, "A"), (504, "a b"), (3, rows[3][1])]
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    want = {(rows[i][0], len(sets[i]), rows[group[i]][0]) for i in range(len(rows))}
    docs = make(spark, rows)
    got = ngram_join.grouped(docs, n, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    kept = ngram_join.keep_one(docs, n, percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})
    assert kept.columns == docs.columns and ngram_join.grouped(docs.limit(0)).count() == 0


def test_one_row_of_each_component_whatever_the_ids(spark):
    a, b, c, d, e = (prose(s, 60, 3000) for s in range(400, 405))
    rows = [(None, a), (None, b), (None, b.upper()), (None, b), (7, c), (7, d), (7, d), (8, e), (None, e),
            (None, ""), (None, None), (None, ""), (9, ""), (9, " ")]
    kept = [(r.doc_id, (r.text or "").lower(), r.text is None)
            for r in ngram_join.keep_one(make(spark, rows), 5, 80).collect()]
    want = [(i, t or "", t is None) for i, t in
            [(None, a), (None, b), (7, c), (7, d), (8, e), (None, ""), (None, None), (9, ""), (9, " ")]]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_no_column_is_lost_where_names_clash(spark):
    docs = make(spark, [(1, prose(1, 40)), (2, prose(1, 40)), (3, prose(2, 40))])
    for name in ("_tag", "_kept_id", "_kept_tag", "tag"):
        docs = docs.withColumn(name, docs.doc_id * 10)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r._tag, r._kept_id, r._kept_tag, r.tag) for r in kept.collect()) == [
        (1, 10, 10, 10, 10), (3, 30, 30, 30, 30)]


def test_tree_finds_every_close_pair():
    draw = np.random.default_rng(2)
    points = draw.integers(0, 9, (300, 8))
    sizes, marks = points.sum(axis=1), draw.integers(0, 40, 300)
    i, j = ngram_join.close_pairs(points, sizes, marks, 60)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if marks[a] != marks[b] and
            np.minimum(points[a], points[b]).sum() >= np.ceil((sizes[a] + sizes[b]) * 60 / 160 - 1e-9)}
    assert got == want


def test_urls_of_every_kind(spark):
    rows = [(None, "http://a.com/free/bets", "x")] * 2 + [(1, None, "x"), (1, "http://h/" + "a/" * 50_000 + "porn", "x")]
    docs = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = Counter((r.page_id, r.verdict) for r in url_vocab.judge_urls(docs).collect())
    assert got == {(None, "block"): 2, (1, "allow"): 1, (1, "block"): 1}
    assert url_vocab.judge_urls(docs.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?q#f"), (2, "http://x.net/"), (3, "http://casino.com/a"),
            (4, "http://essex.com/alphabet"), (5, "http://free-bets.com"), (6, None), (7, "no"), (8, "a://h"),
            (9, "x://q.example.com/de/"), (10, "http://my.org/fr/porn")]
    docs = spark.createDataFrame(rows, "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_vocab.judge_urls(docs).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("x.net", "/", "net/", "block"),
        3: ("casino.com", "/a", None, "block"), 4: ("essex.com", "/alphabet", None, "allow"),
        5: ("free-bets.com", "", None, "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("h", "", None, "allow"), 9: ("q.example.com", "/de/", "example.com/de/", "block"),
        10: ("my.org", "/fr/porn", "org/fr/", "allow")}


def test_pipeline_keeps_the_columns_and_its_decisions(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "ngram_jaccard", "decontamination", "personal_data", "mixture"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes and 0 < out.count() <= docs.count()
    assert corpus_pipeline.run(spark, sf_dir).where("taken > 3 * size").count() == 0
