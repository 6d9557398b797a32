"""Every operator against nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns; and what brute force says."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnwise.llm import bpe, chat, common, decontaminate, jaccard, language, neighbours, sharding, substrings, url_filter, warc
from tests.llm.test_operators import docs, sets

RND = random.Random(77)
WORDS = ["".join(RND.choice("abcdefgh") for _ in range(RND.randint(3, 8))) for _ in range(3000)]


def say(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


LONG = say(60_000)
ROWS = [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, LONG, "en"), (5, "tie here and there", "en"), (6, "tie here and there", "en"), (6, "tie here and there", "en"), (None, "no id at all", "en"), (7, "\x00 ퟿ ß 12", None)]
#: Columns with the names that operators use for their own.
CLASH = {"n_spans": "7", "cut_words": "7", "n_words": "7", "spans": "7", "items": "7", "lang_pred": "'x'", "score": "0.5", "pivot": "7", "node": "7", "s": "7", "n": "7", "__text": "'x'", "ids": "7", "size": "7"}


def clashing(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("*", *(F.expr(v).alias(k) for k, v in CLASH.items()))


BENCH = [(1, "tie here and"), (2, " ".join(LONG.split()[50_000:50_020])), (3, None), (3, "")]


def apply_all(spark, df):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    teach = spark.createDataFrame([(1, "tie here and there", "en"), (2, "dort und da", "de")], "doc_id long, text string, lang string")
    return {
        "op1": sharding.shard(df, 5), "op5": substrings.dedupe(df), "op6": language.identify(df, teach), "op7": bpe.tokenize(df),
        "op9": jaccard.components(df), "op10": decontaminate.find(df, bench), "clean": decontaminate.clean(df, bench),
    }


def test_odd_rows_of_documents(spark):
    got = {k: [r.asDict() for r in v.collect()] for k, v in apply_all(spark, clashing(spark)).items()}
    assert all(len(v) == len(ROWS) for k, v in got.items() if k != "clean")
    by = {k: {r["doc_id"]: r for r in v} for k, v in got.items()}
    assert by["op10"][4]["items"] == ["2"] and by["op10"][5]["items"] == ["1"] and by["op10"][1]["n_words"] == 0 and by["op10"][4]["cut_words"] == 7
    assert by["op9"][6]["component_id"] == 5 and by["op9"][1]["n_shingles"] == 0 and by["op9"][None]["component_id"] is None and by["op9"][4]["n_shingles"] == len(sets(LONG))
    assert by["op6"][1]["lang_pred"] == "und" and by["op6"][5]["lang_pred"] == "en" and by["op6"][4]["size"] == 7
    assert by["op7"][1]["n_tokens"] == 0 and by["op7"][4]["n_tokens"] > 60_000
    assert by["op5"][1]["text"] is None and by["op5"][4]["text"] == LONG and by["op5"][4]["node"] == 7
    assert 4 in by["clean"] and 1 in by["clean"] and len(by["clean"][4]["text"].split()) == 59_980


def test_empty_tables_of_documents(spark):
    assert all(v.count() == 0 for v in apply_all(spark, clashing(spark).limit(0)).values())


def test_ids_that_are_no_numbers_are_refused(spark):
    df = spark.createDataFrame([("a", "x", None, None)], "doc_id string, text string, embedding array<double>, html string").withColumn("vec_id", F.col("doc_id")).withColumn("page_id", F.col("doc_id")).withColumn("url", F.col("doc_id"))
    for ask in (lambda: substrings.dedupe(df), lambda: jaccard.components(df), lambda: neighbours.nearest(df, df), lambda: warc.write(df, "file:///nowhere")):
        with pytest.raises(TypeError):
            ask()


def test_odd_pages_conversations_and_urls(spark, tmp_path):
    pages = [(1, None, None), (2, "http://x/" + "a" * 200_000, LONG), (2, "http://x/" + "a" * 200_000, LONG), (3, "", LONG), (None, "http://n/", "n")]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, first long, digest string")
    warc.write(df, f"file://{tmp_path}/w")
    out = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in out) == Counter({(1, "response", None): 1, (2, "response", None): 2, (3, "revisit", 2): 1, (None, "response", None): 1})
    warc.write(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0
    urls = url_filter.judge(df.withColumn("verdict", F.lit(1)).withColumn("host", F.lit(2)))
    assert urls.count() == 5 and len({(r.verdict, r.score) for r in urls.where("page_id = 2").collect()}) == 1 and url_filter.judge(df.limit(0)).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", LONG, 5), (1, 0, "user", LONG, 5), (2, 0, None, None, 5)], "conv_id long, turn long, role string, text string, segment int")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(turns)).collect()}
    assert got[1].n_turns == 2 and got[1].formatted_chars == 2 * (len(LONG) + 28) and got[2].n_turns == 1
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0


def test_many_pages_of_one_payload_revisit_the_first(spark, tmp_path, monkeypatch):
    df = spark.range(300).selectExpr("id page_id", "concat('http://h/', id % 7) url", "case when id % 3 = 0 then 'same' else cast(id as string) end html")
    got = []
    for k, small in enumerate((10_000, 0)):  # broadcast, and joined
        monkeypatch.setattr(warc, "SMALL", small)
        warc.write(df, f"file://{tmp_path}/{k}")
        got.append(sorted((r.page_id, r.refers_to if r.refers_to is not None else -1) for r in warc.read(spark, f"file://{tmp_path}/{k}").collect()))
    assert got[0] == got[1] == [(k, 0 if k % 3 == 0 and k else -1) for k in range(300)]


def test_sharding_is_the_walk_of_single_keys(spark):
    """Key by key, clockwise from its own arc: first come what the arc's shard has room for, then what overflows, arc by arc."""
    rows = [(RND.randint(0, 400), say(RND.randint(0, 3))) for _ in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df, 5).collect()
    ring = sharding.points(5)
    h = {r.doc_id: r.h & (1 << 64) - 1 for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect()}
    bounds = [s for s, _ in ring]
    arc = lambda i: int(np.searchsorted(bounds, h[i] >> 48)) % len(ring)
    load = Counter(arc(i) for i, _ in rows)
    room = [len(rows) // 5 + (s < len(rows) % 5) for s in range(5)]
    want = Counter()
    over = []
    for a, (_, s) in enumerate(ring):
        k = min(load[a], room[s])
        room[s] -= k
        want[s, a] += k
        over.append(load[a] - k)
    for a, left in enumerate(over):
        to = a
        while left:
            to = (to + 1) % len(ring)
            k = min(left, room[ring[to][1]])
            room[ring[to][1]] -= k
            want[ring[to][1], a] += k
            left -= k
    assert Counter((r.shard, arc(r.doc_id)) for r in got) == +want
    assert all(r.home == ring[arc(r.doc_id)][1] for r in got)


def test_one_more_shard_moves_little(spark):
    df = spark.range(20_000).selectExpr("id doc_id", "'x' text")
    a, b = ({r.doc_id: r.shard for r in sharding.shard(df, n).collect()} for n in (20, 21))
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert moved < 0.5  # dealing anew by hash modulo would move 95 %


def test_url_scores_threshold_and_verdicts_are_brute_forced(spark):
    urls = [f"http://{RND.choice('xyz')}{k}.{'com' if k % 2 else 'org'}/{'de' if k % 2 else 'w'}/{say(1)}" for k in range(150)] + [f"http://{say(1)}.net/{'de' if k % 2 else 'w'}/{k}" for k in range(40)]
    out = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()

    def grams(u):
        text = [0] * 3 + [int(url_filter.ALPHABET[b]) for b in u.partition("://")[2].encode()]
        return [tuple(text[i : i + 4]) for i in range(len(text) - 3)]

    count = {v: Counter() for v in ("allow", "block")}
    for r in out:
        if r.rule:
            for g in grams(urls[r.page_id]):
                for k in range(4):
                    count[r.verdict][g[3 - k :]] += 1
    follow = {v: Counter(g[:-1] for g in c) for v, c in count.items()}
    total = {v: Counter() for v in count}
    for v, c in count.items():
        for g, n in c.items():
            total[v][g[:-1], len(g)] += n

    def p(v, g):
        if not g:
            return 1 / 32
        n, kinds = total[v][g[:-1], len(g)], sum(1 for x in range(32) if count[v][g[:-1] + (x,)])
        low = p(v, g[1:])
        return (count[v][g] + kinds * low) / (n + kinds) if n else low

    for r in out[::7]:
        own = grams(urls[r.page_id])
        want = sum(np.log(p("allow", g)) - np.log(p("block", g)) for g in own) / len(own)
        assert np.isclose(r.score, want)
    assert all(r.verdict == ("allow" if r.score >= r.threshold else "block") for r in out if r.rule is None) and follow
    assert np.mean([(r.score >= r.threshold) == (r.verdict == "allow") for r in out if r.rule]) > 0.95


def naive_chunks(text):
    """Gear hash byte by byte, boundaries word by word."""
    data = text.encode().translate(substrings.SPACES)
    h, marks, words, at = 0, [], [], 0
    for i, b in enumerate(data):
        h = (h << 1) + int(substrings.GEAR[b]) & 0xFFFFFFFF
        if b != 32 and (i + 1 == len(data) or data[i + 1] == 32):
            marks.append(h)
            words.append(i)
    reach = substrings.REACH
    out, last, sure_last = [], -1, -1
    for k, m in enumerate(marks):
        left = [marks[j] for j in range(max(0, k - reach), k)]
        right = [marks[j] for j in range(k + 1, min(len(marks), k + reach + 1))]
        top = all(m > x for x in left) and all(m >= x for x in right)
        level = m in left and all(m >= x for x in left + right)
        if top or (level and k - sure_last >= substrings.STEP):
            sure_last = k
            while k - last > substrings.MOST:
                last += substrings.MOST
                out.append(last)
            out.append(k)
            last = k
    while marks and last < len(marks) - 1:
        last = min(len(marks) - 1, last + substrings.MOST)
        out.append(last)
    starts = [i for i, b in enumerate(data) if b != 32 and (i == 0 or data[i - 1] == 32)]
    stop = [starts[k + 1] if k + 1 < len(starts) else len(data) for k in out]
    return [(s, e, xxhash.xxh3_128_digest(data[s:e].rstrip(b" "))) for s, e in zip([0, *stop], stop)]


def test_chunks_are_the_naive_chunkers():
    for text in [say(700), "a b " * 400, f"{say(40)} {'x ' * 700} {say(40)}", f"  {say(5)}\n\t{say(9)} ", "one", "wörter ñandú " * 30 + say(30)]:
        data = text.encode().translate(substrings.SPACES)
        stop, _ = substrings.ends(data)
        assert stop.tolist() == [e for _, e, _ in naive_chunks(text)]


def test_an_insertion_in_a_long_text_changes_chunks_near_it_only():
    a = LONG * 8
    assert len(a) > 2 * common.SLICE
    b = say(9) + " " + a
    x, y = ([t[s:e].strip() for s, e in zip([0, *stop[:-1].tolist()], stop.tolist())] for t in (a.encode(), b.encode()) for stop in (substrings.ends(t)[0],))
    assert x[4:] == y[len(y) - len(x) + 4 :]


def test_passages_are_cut_as_the_naive_chunks_repeat(spark):
    passage = say(60)
    rows = [(k, f"{say(50)} {passage} {say(50)}") for k in range(4)] + [(9, say(200))]
    seen, spans = set(), {}
    for k, text in rows:
        run, cut = [], 0
        for s, e, d in [*naive_chunks(text), (0, 0, None)]:
            if d in seen:
                run.append(len(text.encode()[s:e].split()))
            else:
                cut += sum(run) >= substrings.LEAST
                run = []
        seen |= {d for _, _, d in naive_chunks(text)}
        spans[k] = cut
    got = {r.doc_id: r.n_spans for r in substrings.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == spans and sum(spans.values()) >= 3


def test_neighbours_dealt_in_blocks_and_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 4 = 0")
    one = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.nearest(df, asked).collect()}
    monkeypatch.setattr(neighbours, "QUERIES", 30)
    monkeypatch.setattr(neighbours, "CANDIDATES", 90)
    many = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.nearest(df, asked).collect()}
    assert one == many and len(one) == 500
    # a query id with two vectors is one query; a candidate id with two is one candidate
    two = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [-1.0, -1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 4)) for r in neighbours.nearest(two, two.where("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == [(1, 0.995), (2, 0.995), (3, 0.7071)]


def test_decontamination_in_many_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MANY", 2)
    monkeypatch.setattr(decontaminate, "HOLD", 200)
    items = [(k, say(RND.randint(1, 30))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, f"{say(20)} {items[k][1]} {say(5)} {items[(k + 7) % 40][1]}", "en") for k in range(40)] + [(99, None, "en")]
    one = {r.doc_id: r for r in decontaminate.find(docs(spark, rows), bench).collect()}
    many = {r.doc_id: r for r in decontaminate.find(docs(spark, rows), bench, most=60).collect()}
    assert one == many and sum(len(r["items"]) for r in one.values()) >= 80
    a, b = ({r.doc_id: r.text for r in decontaminate.clean(docs(spark, rows), bench, most=m).collect()} for m in (200_000, 60))
    assert a == b


def test_jaccard_of_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", 10)
    base = say(60).split()
    rows = []
    for k in range(120):
        w = list(base)
        w[RND.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(w), "en"))
    got = {r.component_id for r in jaccard.components(docs(spark, rows + [(500, say(60), "en")])).collect()}
    assert got == {0, 500}


@pytest.mark.parametrize("share", [1000, 6, 0.5])
def test_jaccard_of_hot_groups_and_repeated_ids(spark, monkeypatch, share):
    """All keys broadcast, hot ones only, none: a third are copies of one text, a third near copies; ids come again with another text, with none, and are null."""
    monkeypatch.setattr(jaccard, "SHARE", share)
    rnd = random.Random(12)
    base, others = [rnd.choice(WORDS) for _ in range(50)], [" ".join(rnd.choice(WORDS) for _ in range(40)) for _ in range(30)]
    near = [" ".join(base[:k] + [f"y{k}"] + base[k + 1 :]) for k in range(40)]
    rows = [(700 + k, others[0]) for k in range(40)] + [(600 - k, t) for k, t in enumerate(near)] + [(100 + k, t) for k, t in enumerate(others)]
    rows += [(90, others[3]), (90, others[4]), (95, ""), (95, others[5]), (95, None), (80, ""), (80, None), (None, others[6]), (None, None), (85, others[7]), (85, others[7])]
    links = {i: {i} for i, _ in rows if i is not None}
    full = [(i, x) for i, t in rows if i is not None and (x := sets(t))]
    for i, x in full:
        for j, y in full:
            if 100 * len(x & y) >= 75 * len(x | y) and links[i] is not links[j]:
                links[i] |= links[j]
                for k in links[i]:
                    links[k] = links[i]
    want = Counter((i, len(sets(t)), None if i is None else min(links[i])) for i, t in rows)
    got = jaccard.components(docs(spark, [(i, t, "en") for i, t in rows])).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, lang, "s", None if t is None else len(t), 5) for i, t, lang in ROWS + [(8, "the cat and the dog sat here", "en"), (9, "der hund und die katze hier", "de")]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_spans int"
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, kept.limit(0), str(tmp_path)).count() == 0, name
        out = common.materialize(stage(spark, kept, str(tmp_path)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema.names == kept.schema.names, name
            kept = out
    left = {r.doc_id for r in out.collect()}
    assert {4, 8, 9} <= left and not left & {1, 2, 3} and len({5, 6} & left) <= 1


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "a"})()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
    assert zlib.crc32(b"") == 0
