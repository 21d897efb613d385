"""BPE, decontamination, n-gram join and the pipeline: against brute force."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from warden.llm import bpe, decontaminate, ngram_join, secret_scan, toxicity
from warden.llm.common import alnum_words, table
from warden.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_bpe(spark, awkward, nothing):
    t = Tokenizer.from_str(bpe.tokenizer_json())
    for docs in (awkward.select("doc_id", "text"), table(spark, SF, "documents")):
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        rows = bpe.bpe(docs, block_bytes=20_000).collect()
        assert len(rows) == docs.count()
        for r in rows:
            ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
            assert r["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.bpe(nothing).count() == 0


def test_bpe_by_plain_joins(spark, awkward, nothing):
    for docs in (awkward, table(spark, SF, "documents"), nothing):
        plain = lambda df: sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in df.select("doc_id", "n_tokens", "ids", "decoded").collect()), key=str)
        assert plain(bpe.bpe_rows(docs)) == plain(bpe.bpe(docs))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("warden_blocks")]


def test_vocabularies_that_look_across_words_are_refused():
    import json

    import public_tokenizers

    with pytest.raises(ValueError, match="single words"):
        bpe.check_vocabulary(bpe.tokenizer_json(public_tokenizers.path("byte_bpe_50k.json")))
    spec = json.loads(bpe.tokenizer_json())
    bpe.check_vocabulary(json.dumps(spec))
    spec["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError):
        bpe.check_vocabulary(json.dumps(spec))


def test_packing():
    for x in ([], [0], [1, 2**32 - 1, 7]):
        assert bpe.unpack(bpe.pack(np.array(x, np.uint32))).tolist() == x


def brute_hits(words, items, window):
    hit, found = set(), set()
    for item, w in items:
        for k in range(max(1, len(w) - window + 1)) if w else ():
            g = w[k : k + window]
            for i in range(len(words) - len(g) + 1):
                if words[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    found.add(item)
    return len(hit), sorted(found, key=str)


@pytest.mark.parametrize("shard,block", [(1 << 20, 8 << 20), (50, 60)])
def test_decontaminate(spark, frame, shard, block):
    r = random.Random(4)
    item_rows = [(i, " ".join(r.choice("abc") for _ in range(n))) for i, n in enumerate((3, 12, 15, 1, 0, 10))] + [(6, None), (7, "Zz, q!"), (1, "a b c d")]
    docs = [(i, " ".join(r.choice("abcd") for _ in range(r.randrange(0, 120)))) for i in range(40)] + [(40, None), (41, ""), (42, item_rows[1][1] + " " + item_rows[2][1]), (42, item_rows[1][1] + " " + item_rows[2][1]), (43, "zz q"), (None, item_rows[1][1])]
    bench = frame(item_rows, "item_id long, text string")
    out = decontaminate.decontaminate(frame([(*d, "x") for d in docs], "doc_id long, text string, n_words string").select("doc_id", "text"), bench, shard_words=shard, block_bytes=block).collect()
    items = [(str(i), alnum_words(t)) for i, t in item_rows]
    texts = dict(docs)
    assert len(out) == len(docs)
    for x in out:
        n, found = brute_hits(alnum_words(texts[x["doc_id"]]), items, 10)
        assert (x["_n_words"], x["_n_hit"], x["_items"]) == (len(alnum_words(texts[x["doc_id"]])), n, found)
    longest = {x["doc_id"]: (x["_longest_match"], x["_longest_start"]) for x in out}
    assert longest[42][0] >= 12
    kept = decontaminate.clean(frame(docs, "doc_id long, text string"), bench)
    assert kept.count() == sum(x["_n_hit"] == 0 for x in out) and kept.columns == ["doc_id", "text"]
    assert decontaminate.decontaminate(frame(docs, "doc_id long, text string"), bench.limit(0)).where("_n_hit > 0").count() == 0
    assert decontaminate.decontaminate(frame(docs, "doc_id long, text string").limit(0), bench, block_bytes=block).count() == 0


def brute_longest(words, items, window):
    best = (0, None)
    for i in range(len(words)):
        for _, w in items:
            for k in range(max(1, len(w) - window + 1)) if w else ():
                n = min(window, len(w))
                if words[i : i + n] == w[k : k + n]:
                    while i + n < len(words) and k + n < len(w) and words[i + n] == w[k + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, i)
    return best


@pytest.mark.parametrize("shard,block", [(1 << 20, 8 << 20), (60, 8 << 20), (1 << 20, 40), (60, 40)])
def test_blocks_and_shards_change_nothing(frame, shard, block):
    """Repeated ids and items, equal windows of several items, clashing names: one answer for every block and shard size."""
    r = random.Random(8)
    base = [r.choice("abcde") for _ in range(60)]
    item_rows = [("a", "x y z"), ("a", "x y z"), ("b", "q"), ("c", " ".join(base[:30])), ("d", " ".join(base[5:40])), ("c", "q"), ("a", " ".join(base[20:50])), (None, "n m"), ("e", "q q"), ("f", None), ("g", "")]
    docs = [(1, "x y z", 7), (2, "q", 7), (3, " ".join(["w", *base, "w"]), 7), (4, " ".join(base[:12] + ["w"] + base[3:33]), 7), (5, "q q q q " * 30, 7), (6, None, 7), (7, "n m", 7), (None, "x y z", 7), (8, " ".join(base[8:17]), 7)]
    items = [(i, alnum_words(t)) for i, t in item_rows]
    frames = frame(docs, "doc_id long, text string, _hits long"), frame(item_rows, "item_id string, text string")
    out = decontaminate.decontaminate(*frames, shard_words=shard, block_bytes=block)
    assert out.columns == ["doc_id", *dict(decontaminate.STATE)]
    texts = {i: t for i, t, _ in docs}
    rows = out.collect()
    assert len(rows) == len(docs)
    for x in rows:
        words = alnum_words(texts[x["doc_id"]])
        n, found = brute_hits(words, items, 10)
        assert (x["_n_words"], x["_n_hit"], x["_items"]) == (len(words), n, sorted({i for i in found if i is not None}))
        assert (x["_longest_match"], x["_longest_start"]) == brute_longest(words, items, 10)
    kept = decontaminate.clean(*frames, shard_words=shard, block_bytes=block)
    assert kept.columns == ["doc_id", "text", "_hits"] and sorted(k["doc_id"] for k in kept.collect()) == [6, 8]


@pytest.mark.parametrize("block", [8 << 20, 10])
def test_items_without_an_id_hit(frame, block):
    bench = frame([(None, "p q r s"), (1, "k l m"), (None, "u v")], "item_id long, text string")
    docs = frame([(1, "x p q r s y"), (2, "k l m u v"), (3, "p q")], "doc_id long, text string")
    out = decontaminate.decontaminate(docs, bench, block_bytes=block).collect()
    assert {(x["doc_id"], x["_n_hit"], tuple(x["_items"])) for x in out} == {(1, 4, ()), (2, 5, ("1",)), (3, 0, ())}
    assert [x["doc_id"] for x in decontaminate.clean(docs, bench, block_bytes=block).collect()] == [3]


def brute_sets(texts):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(lower).split()
        out[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    return out


def brute_components(sets):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def near_copies(seed=5):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[r.choice(words) for _ in range(n)] for n in (30, 60, 60, 120, 200)]
    docs = {}
    for b in base:
        for _ in range(45):
            c = list(b)
            for _ in range(r.randrange(0, max(2, len(b) // 25))):
                c[r.randrange(len(c))] = r.choice(words)
            docs[len(docs)] = " ".join(c)
    for _ in range(30):  # a passage that many otherwise different documents share
        docs[len(docs)] = " ".join(base[1][:25] + [r.choice(words) for _ in range(40)])
    docs |= {len(docs) + k: t for k, t in enumerate((None, "", "a", "a", "a b", "A B", "a b c d", docs[0], docs[0]))}
    return docs


@pytest.mark.parametrize("crowded", [2, 32])
def test_ngram_join(frame, monkeypatch, crowded):
    monkeypatch.setattr(ngram_join, "CROWDED", crowded)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    docs = near_copies()
    sets = brute_sets(docs)
    want = brute_components(sets)
    got = ngram_join.ngram_join(frame([(i, t, 3) for i, t in docs.items()], "doc_id long, text string, n int")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in docs}
    assert len({v for v in want.values()}) < len(docs) - 50


def test_trie_finds_exactly_the_links():
    r = random.Random(6)
    pool = [r.getrandbits(64) for _ in range(60)]
    for _ in range(40):
        sets = [np.unique(np.array(r.sample(pool, r.randrange(1, 50)), np.uint64)) for _ in range(12)]
        sets += [np.unique(np.append(s[1:], np.uint64(r.choice(pool)))) for s in sets]
        paths = sorted(s.astype(">u8").tobytes() for s in sets)
        right = [set(np.frombuffer(p, ">u8").tolist()) for p in paths]
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(right) if 100 * len(b & set(a.tolist())) >= 85 * len(b | set(a.tolist()))}
        assert set(ngram_join.trie_links(sets, paths)) == want


def test_ngram_join_awkward(awkward, nothing):
    rows = ngram_join.ngram_join(awkward).collect()
    assert len(rows) == awkward.count() and ngram_join.ngram_join(nothing).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["component_id"] == 7 and by[2]["n_shingles"] == 0 and by[2]["component_id"] == 2
    kept = ngram_join.one_each(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 8").count() == 0 and kept.where("doc_id is null").count() == 1


@pytest.mark.parametrize("crowded", [2, 32])
def test_ngram_join_by_node_not_by_id(frame, monkeypatch, crowded):
    """A bridge without an id, and one id on rows with different texts."""
    monkeypatch.setattr(ngram_join, "CROWDED", crowded)
    words = [f"w{k}" for k in range(100)]
    near = lambda *at: " ".join("x" + str(k) if k in at else w for k, w in enumerate(words))
    left, bridge, right = near(10, 20), near(10), near()
    assert brute_components(brute_sets({1: left, 2: right})) == {1: 1, 2: 2}
    other = " ".join(f"z{k}" for k in range(80))
    docs = [(1, left), (None, bridge), (2, right), (3, other), (3, left), (4, other + " end"), (None, "only here and nowhere"), (None, "only here and nowhere"), (5, None), (5, None), (6, ""), (7, "7 8 9 10"), (7, "7 8 9 10"), (8, "7 8 9 10")]
    rows = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(frame(docs, "doc_id long, text string")).collect()), key=str)
    want = [(1, 97, 1), (2, 97, 1), (3, 77, 3), (3, 97, 1), (4, 78, 3), (5, 0, 5), (5, 0, 5), (6, 0, 6), (7, 1, 7), (7, 1, 7), (8, 1, 7), (None, 97, 1), (None, 1, None), (None, 1, None)]
    assert rows == sorted(want, key=str)
    named = frame([(i, t, 0, "d") for i, t in docs], "doc_id long, text string, _kept int, i string")
    kept = ngram_join.one_each(named)
    assert kept.columns == named.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, left), (3, other), (None, "only here and nowhere"), (5, None), (6, ""), (7, "7 8 9 10")], key=str)


def test_ngram_join_regions_of_several_components(frame, monkeypatch):
    """Crowds that share one passage: hubs settle some, blocks of few sets and bytes find the other links."""
    monkeypatch.setattr(ngram_join, "CROWDED", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 2000)
    r = random.Random(12)
    common = [f"c{k}" for k in range(50)]
    docs = {}
    for group in range(9):
        own = [f"g{group}_{k}" for k in range(r.randrange(4, 14))]
        for _ in range(r.randrange(1, 9)):
            words = common + own
            for _ in range(r.randrange(0, 3)):
                words[r.randrange(len(words))] = f"r{r.random()}"
            docs[len(docs)] = " ".join(words)
    want = brute_components(brute_sets(docs))
    got = ngram_join.ngram_join(frame(list(docs.items()), "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want and 1 < len(set(want.values())) < len(docs)


def test_pipeline_against_brute_force(spark):
    docs, labels, bench = (table(spark, SF, t) for t in ("documents", "labels", "benchmark"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    g = toxicity.fit(docs, labels)
    texts = {i: t for i, t in texts.items() if g.score(g.counts(t)) < toxicity.THRESHOLD}
    want = brute_components(brute_sets(texts))
    texts = {i: t for i, t in texts.items() if want[i] == i}
    items = [(str(r["item_id"]), alnum_words(r["text"])) for r in bench.collect()]
    grams = {b" ".join(w[k : k + 10]) for _, w in items for k in range(max(1, len(w) - 9)) if w}
    assert all(len(w) >= 10 for _, w in items)
    texts = {i: t for i, t in texts.items() if not grams & {b" ".join(alnum_words(t)[k : k + 10]) for k in range(len(alnum_words(t)))}}
    kept = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = secret_scan.fit(kept)
    t = Tokenizer.from_str(bpe.tokenizer_json())
    want = {}
    for i, x in texts.items():
        ids = t.encode(secret_scan.masked(x, secret_scan.spans_of(x, model)[1], "[secret]"), add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in got} == want
    assert 0 < len(got) < docs.count() and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontaminate", "secret_scan", "bpe"]


def test_every_operator_is_registered():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
