import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tarnwise.llm import bpe, chat, common, decontaminate, jaccard, language, neighbours, sharding, substrings, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, n_words int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, 7, 0.5, 3) for i, t, lang in rows], DOCS)


ODD = [(1, None, "en"), (2, "", "en"), (3, "   ", None), (4, "same text of some words here", "en"), (5, "same text of some words here", "en"), (5, "same text of some words here", "en"), (None, "no id for this text here", "en"), (6, "a " * 40_000, "en"), (7, "wort " * 3 + "ß", "de"), (8, "12 34", None)]


def test_sharding_counts_and_ring(spark):
    out = sharding.shard(docs(spark, ODD), 4).collect()
    assert sum(1 for _ in out) == len(ODD) and sorted(Counter(r.shard for r in out).values()) == [2, 2, 3, 3]
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert {(r.size, r.text_crc32) for r in out if r.doc_id in (1, 2)} == {(16, 0)}
    assert sharding.shard(docs(spark, []), 4).count() == 0
    # one key, very often: dealt over the shards all the same
    hot = sharding.shard(spark.range(1000).selectExpr("1L doc_id", "'x' text"), 7).collect()
    assert max(Counter(r.shard for r in hot).values()) - min(Counter(r.shard for r in hot).values()) == 1


def test_ring_walk_is_the_walk_of_single_keys():
    rnd = random.Random(1)
    ring = sharding.points(5, 4)
    counts = [rnd.randint(0, 9) for _ in ring]
    n = sum(counts)
    room = [n // 5 + (s < n % 5) for s in range(5)]
    got = Counter()
    for _, lo, hi, shard, _ in sharding.walk(counts, ring, room):
        got[shard] += hi - lo
    assert [got[s] for s in range(5)] == room


def test_url_rules_and_model(spark):
    urls = [("HTTP://A.Org/x?y", "allow", "org/"), ("http://example.org/es/1", "block", "example.org/es/"), ("http://www.example.org/en/12", "block", "example.org/en/1"), ("http://b.com/fr/", "allow", "com/fr/"), ("http://b.com/de/#z", "block", "com/de/"), ("no scheme", None, None), (None, None, None), ("", None, None)]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(urls)], "page_id long, url string")).collect()}
    for k, (_, verdict, rule) in enumerate(urls):
        assert out[k].rule == rule and (verdict is None or out[k].verdict == verdict) and out[k].verdict in ("allow", "block")
    assert (out[0].host, out[0].path, out[5].host, out[5].path) == ("a.org", "/x", "", "")


def test_every_ruled_url_is_counted_and_calibrates(spark):
    rnd = random.Random(2)
    rows = [(f"http://a{rnd.randint(0, 9999)}.{'com' if k % 2 else 'org'}/{'de' if k % 2 else 'x'}/{k}", "block" if k % 2 else "allow") for k in range(400)] + [("http://hot.org/qqq", "allow")] * 300
    table, limit = url_filter.fit(spark.createDataFrame(rows, "url string, verdict string"))
    count = {v: np.bincount(url_filter.codes([u for u, w in rows if w == v])[0], minlength=url_filter.CELLS) for v in ("allow", "block")}
    assert np.allclose(table, url_filter.log_probs(count["allow"]) - url_filter.log_probs(count["block"]))
    x = url_filter.score([u for u, _ in rows], table)
    assert np.mean([(s >= limit) == (v == "allow") for s, (_, v) in zip(x, rows)]) > 0.95


def test_log_probs_sum_to_one_and_match_brute_force():
    rnd = np.random.default_rng(0)
    count = np.zeros(url_filter.CELLS)
    count[rnd.integers(0, url_filter.CELLS, 500)] += 1
    p = np.exp(url_filter.log_probs(count)).reshape(-1, 32)
    assert np.allclose(p.sum(1), 1)
    cell = int(np.flatnonzero(count)[0])
    want = 1 / 32
    for k in range(4):
        ctx, sym = (cell >> 5) % 32**k, cell % 32
        row = count.reshape(-1, 32 ** (k + 1)).sum(0).reshape(-1, 32)[ctx]
        want = (row[sym] + (row > 0).sum() * want) / (row.sum() + (row > 0).sum()) if row.sum() else want
    assert np.isclose(p.reshape(-1)[cell], want)


def test_chat_round_trip():
    rnd = random.Random(2)
    parts = ["<", "|", "\\", "n", "\n", chat.START, chat.END, "a", "<n|"]
    for _ in range(3000):
        role, body = ("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6))) for _ in range(2))
        assert chat.parse(chat.render(role, body))[0][:2] == (role, body)


def test_chat_digests(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>x"), (1, 1, None, None), (2, 5, "assistant", "é")]
    out = {r.conv_id: r for r in chat.digests(chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert (out[1].n_turns, out[1].loss_chars, out[2].loss_chars) == (3, 11, 1)
    assert out[1].loss_sha256 == hashlib.sha256(b"<|im_end|>x").hexdigest()
    assert out[1].turns_sha256 == hashlib.sha256("user\nhi\n\n\nassistant\n<|im_end|>x\n".encode()).hexdigest()


def test_warc_round_trip(spark, tmp_path):
    pages = [(3, "http://b/", "x\r\n\r\nWARC/1.1\r\ny"), (2, "http://a/z", "x\r\n\r\nWARC/1.1\r\ny"), (1, None, None), (5, "http://a/b", ""), (9, "http://a/é", "ü\n"), (7, "http://c/", "\r\n")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, first string")
    warc.write(df, f"file://{tmp_path}/w")
    out = warc.read(spark, f"file://{tmp_path}/w").collect()
    by = {r.page_id: r for r in out}
    assert len(out) == len(pages) and (by[3].refers_to, by[2].refers_to, by[5].refers_to, by[1].record_type) == (2, None, 1, "response")
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    keys = [(r.url_key.encode(), r.ts, r.page_id) for r in out]
    assert keys == sorted(keys)


def test_loser_tree_merges():
    rnd = random.Random(3)
    for k in range(8):
        runs = [sorted(rnd.randint(0, 20) for _ in range(rnd.randint(0, 9))) for _ in range(k)]
        assert list(warc.loser_tree([iter(r) for r in runs], lambda x: x)) == sorted(sum(runs, []))


def test_substrings_cut_later_passages_only(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(4000)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = say(60)
    rows = [(k, f"{say(80)} {passage} {say(70)}" if k < 3 else say(150), "en") for k in range(8)]
    out = {r.doc_id: r for r in substrings.dedupe(docs(spark, rows + [(None, passage, "en"), (50, None, "en"), (51, "", "en")])).collect()}
    assert [out[k].n_spans > 0 for k in range(8)] == [False, True, True] + [False] * 5
    assert out[1].cut_words >= 35 and passage not in out[1].text and out[0].text == rows[0][1] and out[50].text is None
    twice = substrings.dedupe(docs(spark, [rows[0], rows[0]])).collect()
    assert all(r.n_spans == 0 for r in twice)


def test_runs_of_repeated_words_are_cut(spark):
    rnd = random.Random(8)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 9))) for _ in range(n))
    unit = [["lorem"], ["lorem", "ip"], ["lorem", "ip", "dolore"], ["a"]]
    for words in unit:
        run = lambda n, words=words: " ".join((words * n)[:n])
        rows = [(k, f"{say(80 + 7 * k)} {run(51 + 11 * k)} {say(70)}", "en") for k in range(4)] + [(9, say(300), "en")]
        out = {r.doc_id: r for r in substrings.dedupe(docs(spark, rows)).collect()}
        assert all(out[k].n_spans and out[k].cut_words >= 24 for k in (1, 2, 3)) and out[9].text == rows[4][1]
        left = {k: out[k].text.split() for k in range(4)}
        assert all(left[k][: 80 + 7 * k] == rows[k][1].split()[: 80 + 7 * k] and left[k][-70:] == rows[k][1].split()[-70:] for k in range(4))


def test_chunks_do_not_depend_on_slices(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 9))) for _ in range(5000)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    long = say(170_000)
    assert len(long) > common.SLICE + 50_000
    data = np.frombuffer(long.encode(), np.uint8)
    assert (substrings.marks(data, np.arange(len(data)), 1000) == substrings.gear(data)).all()
    out = {r.doc_id: r for r in substrings.dedupe(docs(spark, [(0, long, "en"), (1, f"{say(30)} {long}", "en")])).collect()}
    assert out[0].n_spans == 0 and out[1].n_spans == 1 and len(out[1].text.split()) < 60


def test_gear_depends_on_32_bytes():
    a, b = b"x" * 100 + b"some words that follow here and on", b"other" + b"some words that follow here and on"
    assert substrings.gear(np.frombuffer(a, np.uint8))[-1] == substrings.gear(np.frombuffer(b, np.uint8))[-1]


def segmentations(lat, p, s):
    """Every way to cut s into pieces of the whole vocabulary, of any width, with its probability."""
    if not s:
        yield 1.0, []
    for k in range(1, len(s) + 1):
        piece = lat.ids.get(s[:k], 1 if k == 1 else 0)
        if piece:
            yield from ((p[piece] * x, [piece, *rest]) for x, rest in segmentations(lat, p, s[k:]))


def sums(lat, p, s):
    """The same sum from right to left, for words that have too many segmentations to list."""
    b = [0.0] * len(s) + [1.0]
    for i in range(len(s) - 1, -1, -1):
        b[i] = sum(p[lat.ids.get(s[i:j], 1 if j == i + 1 else 0)] * b[j] for j in range(i + 1, len(s) + 1))
    return b[0]


def test_words_are_summed_over_the_whole_vocabulary():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=language.vocabulary())
    normal = (sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k)))
    pieces = {p for p in normal if p == p.lower() and all(c == language.MARK or c.isalpha() for c in p)}
    lat = language.Lattice(language.vocabulary())
    assert lat.ids.keys() == pieces | {language.MARK} and lat.wide == max(map(len, pieces))
    p = np.random.default_rng(3).random(lat.size)
    p[0] = 0
    long = sorted((x for x in pieces if len(x) > 7 and x[0] == language.MARK), key=lambda x: (-len(x), x))
    for w in ["hello", "straße", "ж", "naïve", *(x[1:] for x in (*long[:4], *long[-4:])), "x" + long[0][1:9]]:
        cuts = list(segmentations(lat, p, language.MARK + w))
        total, want = sum(x for x, _ in cuts), np.zeros(lat.size)
        for x, used in cuts:
            np.add.at(want, used, 3 * x / total)
        assert np.isclose(language.log_sums(lat, lat.codes([w]), p)[0], np.log(total))
        assert np.allclose(language.expected(lat, lat.codes([w]), p, np.array([3])), want)


def test_long_words_are_one_word_each():
    lat = language.Lattice(language.vocabulary())
    rng = np.random.default_rng(4)
    p = rng.random((lat.size, 2))
    p[0] = 0
    for n in (8, 23, 24, 25, 33, 47, 48, 49, 100):
        words = ["".join(rng.choice(list("etaonrishdß"), n)) for _ in range(3)]
        got = language.log_sums(lat, lat.codes(words), p)
        for w, x in zip(words, got):
            assert np.allclose(x, [np.log(sums(lat, p[:, k], language.MARK + w)) for k in range(2)])
        count = language.expected(lat, lat.codes(words), p[:, 0], np.array([1, 2, 3]))
        width = np.array([0, 1, *map(len, lat.ids)])
        assert np.isclose((count * width).sum(), 6 * (n + 1))  # the pieces' widths add up to the words
    endless = np.maximum(p / p.sum(0), 1e-9)
    endless[0] = 0
    assert np.isfinite(language.log_sums(lat, lat.codes(["ж" * 50_000]), endless)).all()


def test_rare_language_is_learned_beside_a_large_one(spark):
    rows = [(k, "the cat and the dog sat on the mat with other words", "en") for k in range(3000)]
    rows += [(k, "le chat et le chien sont dans la maison avec des autres", "fr") for k in (9001, 9002)]
    train = docs(spark, rows)
    assert language.fit(train, language.vocabulary(), 40)[0] == ["en", "fr"]
    out = language.identify(docs(spark, [(1, "le chien et le chat", None), (2, "the dog and the cat", None)]), train, 40)
    assert {r.doc_id: r.lang_pred for r in out.collect()} == {1: "fr", 2: "en"}
    one_id = docs(spark, [(7, "the cat", "en")] * 50)
    assert language.fit(one_id, language.vocabulary(), 1)[0] == ["en"]


def test_language_of_odd_rows(spark):
    teach = docs(spark, [(k, "the cat and the dog " * 3, "en") for k in range(5)] + [(k, "der hund und die katze " * 3, "de") for k in range(5, 9)])
    out = {r.doc_id: r for r in language.identify(docs(spark, ODD), teach).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[8].lang_pred == "und" and out[1].score == 0
    assert all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in language.identify(docs(spark, ODD), docs(spark, [])).collect()} == {"und"}


def test_bpe_is_the_librarys(spark):
    import public_tokenizers
    import tiktoken

    path = bpe.rank_file()
    ranks = bpe.load_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abet hion ÉéöñЖ你 \n\t01.,!") for _ in range(rnd.randint(0, 60))) for _ in range(500)] + [None, "", "a" * 3000]
    out = bpe.tokenize(docs(spark, [(k, t, "en") for k, t in enumerate(texts)]), with_ids=True).collect()
    for r in out:
        want = lib.encode_ordinary(texts[r.doc_id] or "")
        assert r.token_ids == want and r.n_tokens == len(want)
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_tables_after_edits():
    enc, rnd = bpe.Encoder(bpe.load_ranks(bpe.rank_file())), random.Random(6)
    for _ in range(200):
        b = bytes(rnd.choice(b"abethionrs") for _ in range(rnd.randint(1, 40)))
        t = bpe.Table(enc, b)
        i = rnd.randint(0, len(b))
        j, x = rnd.randint(i, len(b)), bytes(rnd.choice(b"abethionrs") for _ in range(rnd.randint(0, 6)))
        t.edit(i, j, x)
        assert t.data == b[:i] + x + b[j:] and t.last == bpe.Table(enc, t.data).last and t.ids() == enc.merge(t.data)


def test_bpe_keeps_a_bounded_number_of_pieces(monkeypatch):
    import pyarrow as pa

    path, rnd = bpe.rank_file(), random.Random(7)
    monkeypatch.setattr(bpe, "KEPT", 100)
    monkeypatch.setattr(bpe, "BATCH", 400)
    monkeypatch.setattr(common, "_HELD", {})
    pieces, bytes_of, pattern = bpe.loaded(path)
    enc = bpe.Encoder(bpe.load_ranks(path))
    texts, most = [" ".join("".join(rnd.choice("abethion") for _ in range(rnd.randint(1, 9))) for _ in range(20)) for _ in range(400)], 0
    for text, found in zip(texts, bpe.split_texts(pa.array(texts), path), strict=True):
        got = [ids for part in found for ids in part]
        assert got == [",".join(map(str, enc.encode_piece(p.encode()))) for p in pattern.findall(text)]
        most = max(most, len(pieces) + len(pieces.old))
    assert most < 600  # 100 and those of one batch, twice; there are over 5,000 in all
    for k in range(50):  # long ones count as several
        pieces.learn({"ab" * 2000 + str(k)})
        assert len(pieces) + len(pieces.old) < 600
    assert sum(map(len, [*pieces, *pieces.old])) < 40_000
    ids = np.array(enc.encode_piece("naïve".encode()), np.int32)
    assert bpe.decode_ids(ids, path) == "naïve".encode()


def test_neighbours_are_exact(spark):
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(300, 8))
    x[7], x[9], x[11] = x[8], 0, x[8] * 2
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect()
    ok = [k for k in range(300) if k != 9]
    for q in range(0, 300, 50):
        want = sorted((-float(x[q] @ x[k] / np.linalg.norm(x[q]) / np.linalg.norm(x[k])), k) for k in ok if k != q)[:5]
        got = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert np.allclose([s for _, _, s in got], [-s for s, _ in want]) and [v for _, v, _ in got] == [k for _, k in want]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def sets(text):
    w = [x for x in (text or "").translate({k: k + 32 for k in range(65, 91)}).replace("\n", " ").split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("families", [12, 2])
def test_jaccard_components_match_brute_force(spark, families):
    """Of two families the shingles are hot: their pivots are known before anchors are sent."""
    rnd = random.Random(8)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(4, 60))] for _ in range(families)]
    rows = []
    for k in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"v{rnd.randint(0, 50)}"
        rows.append((k, " ".join(w), "en"))
    rows += [(500, None, "en"), (501, "", "en"), (502, "one two", "en"), (503, "ONE two", "en")]
    s, root = {i: sets(t) for i, t, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in s:
        for j in s:
            if i < j and s[i] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    out = jaccard.components(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (len(s[i]), find(i)) for i in s}
    assert jaccard.components(docs(spark, [])).count() == 0
    assert len(jaccard.components(docs(spark, ODD)).collect()) == len(ODD)


def test_hot_anchors_have_their_pivot_and_a_key_of_their_own():
    s, node, size = np.array([3, 5, 9, 5, 7, 9]), np.array([20, 20, 20, 30, 30, 40]), np.array([8, 8, 8, 9, 9, 2], np.int32)
    rows = jaccard.spread(s, node, size, np.array([5, 9]), np.array([11, 11])).to_pylist()
    assert [(r["s"], r["node"], r["n"], r["pivot"]) for r in rows[:2]] == [(3, 20, 8, None), (7, 30, 9, None)]
    assert [(r["node"], r["n"], r["pivot"]) for r in rows[2:]] == [(20, 8, 11), (30, 9, 11), (40, 2, 11)] and len({r["s"] for r in rows}) == 5
    none = np.zeros(0, np.int64)
    assert jaccard.spread(s, node, size, none, none).column("s").to_pylist() == s.tolist()


def test_region_recursion_and_pairs_agree():
    rnd = np.random.default_rng(9)
    family = [np.unique(rnd.integers(0, 1 << 60, 120, dtype=np.uint64)) for _ in range(4)]
    found = []
    for k in range(120):
        x = family[k % 4].copy()
        x[rnd.integers(0, len(x), 12)] = rnd.integers(0, 1 << 60, 12, dtype=np.uint64)
        found.append(np.unique(x))
    a, b = jaccard.Region(list(range(120)), found), jaccard.Region(list(range(120)), found)
    b.pairs(list(range(120)))
    assert a.joined() == [(k, r) for k in range(120) if (r := b.find(k)) != k]


@pytest.mark.parametrize("letters", [b"ab", b"abc"])
def test_automaton_matches_brute_force(letters):
    rnd = random.Random(10)
    pick = lambda n: [bytes([rnd.choice(letters)]) for _ in range(n)]
    for _ in range(300):
        w = rnd.choice([2, 3, 4])
        items = [(str(i), pick(rnd.randint(0, 9)), True) for i in range(rnd.randint(0, 5))]
        doc = pick(rnd.randint(0, 40)) + [b"z"] + pick(5)
        hit, found = set(), set()
        for name, it, _ in items:
            k = min(w, len(it))
            for i in range(len(doc) - k + 1):
                if it and any(doc[i : i + k] == it[j : j + k] for j in range(len(it) - k + 1)):
                    hit |= set(range(i, i + k))
                    found.add(name)
        spans, got = decontaminate.Automaton(items, w).match(doc)
        assert {x for s, e in spans for x in range(s, e)} == hit and got == found


def test_decontamination_blocks_and_cleaning(spark):
    item = " ".join(f"w{k}" for k in range(40))
    bench = spark.createDataFrame([(1, item), (2, "only three words"), (3, None), (4, "")], "item_id long, text string")
    rows = [(1, f"Start, {item.upper()}! end of a longer text with quite a few words to stay in the end ok", "en"), (2, "say Only-three WORDS now", "en"), (3, "clean", "en"), (4, None, "en"), (5, item, "en")]
    one = {r.doc_id: r for r in decontaminate.find(docs(spark, rows), bench).collect()}
    many = {r.doc_id: r for r in decontaminate.find(docs(spark, rows), bench, most=15).collect()}
    assert one == many and one[1].spans == [1, 41] and one[1]["items"] == ["1"] and one[2]["items"] == ["2"] and one[4].n_words == 0
    left = {r.doc_id: r.text for r in decontaminate.clean(docs(spark, rows), bench).collect()}
    assert 5 not in left and left[3] == "clean" and left[4] is None and "W20" not in left[1] and left[1].startswith("Start, ")
    assert decontaminate.find(docs(spark, rows), bench.limit(0)).where("size(spans) > 0").count() == 0


def test_whole_short_items_are_cut_from_longer_texts(spark):
    bench = spark.createDataFrame([(2, "only three words"), (3, "two words"), (4, "nine words of an item that is a window")], "item_id long, text string")
    rows = [(1, "say Only-three WORDS now", "en"), (2, "here are two words and only three", "en"), (3, "so: nine words of an item, that is a window! then more text and more", "en")]
    left = {r.doc_id: r.text for r in decontaminate.clean(docs(spark, rows), bench).collect()}
    assert left == {1: "say now", 2: rows[1][1], 3: "so: then more text and more"}


def test_bitmap_is_sparks_hash(spark):
    b = common.bitmap(spark.range(500).selectExpr("id * 7919 - 100 k"), "k", 14)
    assert common.in_bitmap(b, np.arange(500, dtype=np.int64) * 7919 - 100).all()
    assert common.in_bitmap(b, np.arange(10**6, 10**6 + 10**4, dtype=np.int64)).mean() < 0.1


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and all(len(r.token_ids) == r.n_tokens for r in out)


def test_language_stage_keeps_documents_when_nothing_is_labelled(spark):
    import corpus_pipeline

    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "\u00dcber", None)]
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs(spark, rows), "").collect()} == {1, 4}
    taught = [(k, "the cat and the dog", "en") for k in range(5, 8)]
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs(spark, rows + taught), "").collect()} == {1, 4, 5, 6, 7}


def test_pipeline_does_the_whole_job(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(21)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 9))) for _ in range(n))
    passage, item, whole = say(60), say(20), say(90)
    texts = {1: whole, 2: whole, 3: f"{say(80)} {passage} {say(60)}", 4: f"{say(80)} {passage} {say(60)}", 5: f"{say(50)} {item} {say(50)}", 6: item, 7: say(70), 8: "12 34", 9: None}
    docs(spark, [(k, t, None if k == 7 else "en") for k, t in texts.items()]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 3, 4, 5, 7]
    without = " ".join([*texts[5].split()[:50], *texts[5].split()[70:]])
    alone = docs(spark, [(k, without if k == 5 else texts[k], "en") for k in (1, 3, 5, 7)])
    want = {r.doc_id: r for r in bpe.tokenize(alone, keep=["doc_id", "lang", "source"], with_ids=True).collect()}
    assert all(got[k].token_ids == want[k].token_ids for k in want)
    full = bpe.tokenize(docs(spark, [(4, texts[4], "en")]), keep=["doc_id", "lang", "source"], with_ids=True).collect()[0]
    assert got[4].n_tokens < full.n_tokens


def test_text_queries_match_brute_force(spark, tmp_path):
    import zlib

    import public_tokenizers
    import tiktoken

    rnd = random.Random(33)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items, passage, base = [say(14), say(12), "only three words"], say(60), [say(30) for _ in range(4)]
    texts = {k: say(80) for k in range(6)} | {k: f"{say(40)} {passage} {say(40)}" for k in (10, 11)} | {k: f"{say(20)} {items[k % 3]} {say(9)}" for k in range(20, 29)}
    texts |= {k: " ".join([*base[k % 4].split()[: 30 - k % 3], f"x{k % 5}"]) for k in range(40, 64)} | {70: None, 71: "", 72: "One two"}
    docs(spark, [(k, t, "en" if k % 2 else "de") for k, t in texts.items()]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda query: {r.doc_id: r for r in query(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    found = run(decontaminate.op10_suffix_automaton_decontamination)
    cut = run(substrings.op5_gear_chunk_dedup)
    langs = run(language.op6_segmentation_language_id)
    tokens = run(bpe.op7_prefix_bpe)
    parts = run(jaccard.op9_jaccard_metric_join)
    assert all(x.keys() == texts.keys() for x in (found, cut, langs, tokens, parts))

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.rank_file()), special_tokens={})
    s, root = {i: sets(t) for i, t in texts.items()}, {i: i for i in texts}
    for _ in texts:
        for i in texts:
            for j in texts:
                if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                    root[i] = root[j] = min(root[i], root[j])
    for k, text in texts.items():
        words, hit, names = decontaminate.split(text), set(), set()
        for name, item in enumerate(map(decontaminate.split, items)):
            n = min(10, len(item))
            windows = {tuple(item[a : a + n]) for a in range(len(item) - n + 1)}
            for a in range(len(words) - n + 1):
                if tuple(words[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    names.add(str(name))
        assert (found[k].n_words, found[k].n_hit, found[k].items_sha256, found[k].contaminated) == (len(words), len(hit), sha(",".join(sorted(names))), bool(hit))
        ids = lib.encode_ordinary(text or "")
        assert tokens[k].n_tokens == len(ids) and tokens[k].ids_sha256 == sha(",".join(map(str, ids))) and tokens[k].decoded_sha256 == sha(text or "")
        assert (parts[k].n_shingles, parts[k].component_id) == (len(s[k]), root[k])
        assert langs[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and (langs[k].lang_pred == "und") == (not text)
        assert cut[k].repeats == (cut[k].n_spans > 0) and (cut[k].repeats or cut[k].text_sha256 == sha(text or ""))
    assert cut[11].repeats and not any(cut[k].repeats for k in [*range(6), 10, *range(20, 29)])
