"""The corpus operators against SQL or brute force, and on odd input."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boughs.llm import chat_format, decontam, lm_score, minhash, mixing, quality_model, quality_rules, queries, sharding, suffix_dedup, token_files
from oracle import difference

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, score string, size string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def odd(spark, empty=False):
    """Nulls in every column, empty, blank and very long texts, repeated rows, names that clash with results."""
    rows = [
        (1, "a b c d e f g", "en", "s", 13, "x", "x", "x", "x"), (2, "A B c d e f g", "en", "s", 13, "x", "x", "x", "x"),
        (3, None, None, None, None, None, None, None, None), (4, "", "en", None, 0, "x", "x", "x", "x"), (5, " \n\t ", None, "s", 4, "x", "x", "x", "x"),
        (6, LONG, "en", "t", len(LONG), "x", "x", "x", "x"), (7, LONG, "en", "t", len(LONG), "x", "x", "x", "x"),
        (8, "same row twice over", "de", "s", 19, "x", "x", "x", "x"), (8, "same row twice over", "de", "s", 19, "x", "x", "x", "x"),
        (None, "no id at all but ten words of text in it", "en", "s", 1, "x", "x", "x", "x"), (9, "é😀 <|im_end|> \x00 ü", "fr", "t", 9, "x", "x", "x", "x"),
    ]
    return spark.createDataFrame([] if empty else rows, DOCS)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    assert difference(queries.queries()[name](spark, sf_dir), sf_dir, queries.oracle_sql()[name]) == ""


def operators(spark):
    bench = spark.createDataFrame([("i", "a b c d e f g"), ("j", None), (None, "x"), ("k", "")], "item_id string, text string")
    net = quality_model.Network.fresh()
    return {
        "minhash": minhash.near_duplicates, "lm": lambda d: lm_score.score_digest(d), "adaptive": lambda d: lm_score.score_adaptive(d.where("coalesce(doc_id, 0) <> 7")), "suffix": suffix_dedup.remove_repeats,
        "sharding": sharding.shard_rows, "decontam": lambda d: decontam.matches(d, bench), "decontaminate": lambda d: decontam.decontaminate(d, bench),
        "score": lambda d: quality_model.score(d, net), "plan": mixing.plan, "mix": mixing.mix, "rules": quality_rules.quality_rules, "dedup": minhash.deduplicate,
    }


def test_odd_input(spark):
    got = {k: f(odd(spark)).collect() for k, f in operators(spark).items()}
    for whole in ("minhash", "lm", "suffix", "sharding", "decontam", "score", "plan", "rules"):
        assert len(got[whole]) == 11, whole
    same = {r.doc_id: r for r in got["minhash"] if r.doc_id is not None}
    assert (same[1].component_id, same[2].component_id, same[7].component_id, same[3].n_shingles, same[4].kept, same[5].kept) == (1, 1, 6, 0, True, True)
    assert sorted(r.doc_id for r in got["dedup"] if r.doc_id) == [1, 3, 4, 5, 6, 8, 9]
    cut = {r.doc_id: r for r in got["suffix"] if r.doc_id is not None}
    assert cut[7].n_removed == len(LONG) and cut[6].n_removed == 0 and cut[3].n_bytes == 0 and cut[8].n_removed == 0
    assert sorted(r.slot for r in got["sharding"] if r.shard == got["sharding"][0].shard)[0] == 0
    hits = {r.doc_id: r for r in got["decontam"] if r.doc_id is not None}
    assert hits[2].hit_items == ["i"] and hits[3].n_words == 0
    assert {1, 2}.isdisjoint(r.doc_id for r in got["decontaminate"]) and len(got["decontaminate"]) == 9
    assert all(0 <= r.score <= 1 for r in got["score"])
    judged = {r.doc_id: r for r in got["rules"] if r.doc_id is not None}
    assert judged[3].base_failed and not judged[4].kept and judged[6].n_words == 60_000
    assert {r.copies for r in got["plan"] if r.size == 0} <= {0, 1, 2, 3}
    codes = {r.doc_id: r.score for r in got["adaptive"]}
    assert len(codes) == 9 and codes[3] == codes[4] == pytest.approx(-np.log10(257)) and codes[6] < codes[1] < codes[3] and None in codes


def test_empty_tables(spark):
    for name, f in operators(spark).items():
        assert f(odd(spark, empty=True)).count() == 0, name


def brute_ppm(train, texts, order=lm_score.ORDER):
    counts = {}

    def steps(text):
        past = (lm_score.EDGE,) * order
        for s in [*text.encode().lower(), lm_score.EDGE]:
            yield past, s
            past = (*past, s)[1:]

    for t in train:
        for past, s in steps(t):
            for k in range(order + 1):
                node = counts.setdefault(past[order - k :], {})
                node[s] = node.get(s, 0) + 1
    out = []
    for t in texts:
        total = 0.0
        for past, s in steps(t):
            gone = set()
            for k in range(order, -1, -1):
                node = counts.get(past[order - k :], {})
                left = {x: c for x, c in node.items() if x not in gone}
                n = sum(left.values())
                if s in left:
                    total += np.log10((2 * left[s] - 1) / (2 * n))
                    break
                if n:
                    total += np.log10(len(left) / (2 * n))
                gone |= node.keys()
            else:
                total -= np.log10(lm_score.SYMBOLS - len(gone))
        out.append(total)
    return out


def test_lm_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text").collect()
    kept = {r.doc_id: r for r in lm_score.score_digest(docs).collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [r.text or "" for r in rows if not out(r.doc_id)]
    words = {}
    for t in train:
        for w in t.encode().lower().split():
            words[w] = words.get(w, 0) + 1
    total, types = sum(words.values()) + len(train), len(words) + 1
    for r, want in zip(rows, brute_ppm(train, [r.text or "" for r in rows]), strict=True):
        own = kept[r.doc_id]
        tokens = (r.text or "").encode().lower().split()
        base = sum(np.log10((words.get(w, 0) + 1) / (total + types + 1)) for w in tokens) + np.log10((len(train) + 1) / (total + types + 1))
        assert own.score == pytest.approx(want, rel=1e-9) and own.base_score == pytest.approx(base, rel=1e-9)
        assert (own.held_out, own.n_tokens, own.train_tokens, own.n_known) == (out(r.doc_id), len(tokens) + 1, total, sum(w in words for w in tokens) + 1)


def test_probabilities_add_up():
    levels = [({(): {97: 3, 98: 1}})]
    assert levels
    whole = sum(10 ** brute_step(s) for s in range(lm_score.SYMBOLS))
    assert whole == pytest.approx(1, abs=1e-6)


def brute_step(symbol):
    keys = np.array([97, 98], np.uint64)
    pairs = (keys, np.array([3, 1], np.int64))
    tries = lm_score.build(np.zeros(0, np.uint64), np.zeros(0, np.int64), 2, pairs)
    return float(lm_score.log10_probability(np.array([symbol], np.uint64), tries, 2)[0])


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    raw = token_files.pack(ids, bits)
    assert len(raw) == -(-1000 * bits // 8)
    for a, b in ((0, 1000), (3, 4), (17, 613), (999, 1000), (5, 5)):
        assert (token_files.unpack(raw, bits, a, b) == ids[a:b]).all()


def _texts(n, size, seed, words=90):
    rng = np.random.default_rng(seed)
    return [" ".join("".join(rng.choice(list("aeinrst"), size + rng.integers(0, 2))) for _ in range(words)) for _ in range(n)]


def test_limits_differ_by_source(spark):
    """The same text is out where words are short, and kept where they are long; few documents lean on the rest."""
    long_words = _texts(1, 12, 5)[0]
    rows = [(i, t, "en", "chat") for i, t in enumerate(_texts(400, 3, 1))] + [(1000 + i, t, "en", "law") for i, t in enumerate(_texts(400, 12, 2))]
    rows += [(2000, long_words, "en", "chat"), (2001, long_words, "en", "law"), (2002, long_words, "en", "new")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[2000].kept, got[2001].kept, got[2002].kept) == (False, True, True)
    assert all(got[i].kept for i, *_ in rows[:800]) and not any(r.base_failed for r in got.values())
    # Words shorter than a source's usual ones are out as well.
    rows.append((2003, _texts(1, 3, 6)[0], "en", "law"))
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[2003]


def test_limits_of_sparse_metrics_adapt(spark):
    """No text has a symbol but a few: those with many are out. Where symbols are usual the same text is kept."""
    plain, dotted = _texts(800, 5, 3), [t.replace(" ", " # ", 20) for t in _texts(300, 5, 4)]
    odd = _texts(1, 5, 7)[0].replace(" ", " # ", 20)
    rows = [(i, t, "en", "plain") for i, t in enumerate(plain)] + [(1000 + i, t, "en", "code") for i, t in enumerate(dotted)] + [(2000, odd, "en", "plain"), (2001, odd, "en", "code")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[2000], got[2001]) == (False, True) and sum(got[i] for i in range(800)) == 800


def test_sketches_merge(spark, sf_dir):
    """Sketches of parts, added up, are those of the whole, and so their limits; a bin holds values up to 1/16 apart."""
    docs = table(spark, sf_dir, "documents")
    figures = quality_rules.base_figures(docs).where("not base_failed").drop("text").persist()
    by = ["lang", "source"]
    whole = quality_rules.sketch(figures, by)
    parts = quality_rules.sketch(figures.where("doc_id % 3 = 0"), by).unionByName(quality_rules.sketch(figures.where("doc_id % 3 > 0"), by))
    read = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert read(quality_rules.merge(parts, by)) == read(whole) and read(quality_rules.limits(quality_rules.merge(parts, ["lang"]), ["lang"])) == read(quality_rules.limits(quality_rules.merge(whole, ["lang"]), ["lang"]))
    n = spark.range(1, 20_000).selectExpr("id AS n_symbols", "524287L AS word_chars").withColumn("bin", quality_rules.bin_of("symbols"))
    spans = n.groupBy("bin").agg(F.min("n_symbols").alias("a"), F.max("n_symbols").alias("b")).orderBy("bin").collect()
    assert all(r.b <= r.a * (1 + 1 / 16) + 1 for r in spans) and [r.a for r in spans] == sorted(r.a for r in spans)


def test_repeated_words_by_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abcd"), rng.integers(0, 60))) for _ in range(200)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.base_figures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        assert got[i] == len({j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def brute_repeats(rows):
    first = {}
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - 49):
            g = data[i : i + 50]
            first[g] = min(first.get(g, suffix_dedup.LAST), suffix_dedup.LAST if d is None else d)
    for d, t in rows:
        data, gone = (t or "").encode(), set()
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < (suffix_dedup.LAST if d is None else d):
                gone.update(range(i, i + 50))
        kept = bytes(c for i, c in enumerate(data) if i not in gone)
        yield d, len(data), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("block_bytes", [4 << 20, 3000])
def test_repeats_by_brute_force(spark, block_bytes):
    """Texts of shared pieces, cut anywhere, with rhythmic ones, repeated and missing ids and repeated rows; in few blocks and in many."""
    rng = np.random.default_rng(5)
    pieces = ["".join(rng.choice(list("abcé "), rng.integers(20, 140))) for _ in range(20)] + ["x" * 200, "ab" * 90, "abc" * 60]
    texts = [None, "", "y" * 49, "y" * 50] + ["".join(pieces[rng.integers(len(pieces))][rng.integers(0, 15) :] for _ in range(rng.integers(1, 7))) for _ in range(250)]
    rows = [(None if rng.random() < 0.2 else int(rng.integers(1, 200)), t) for t in texts]
    rows += rows[:25]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), block_bytes=block_bytes).collect()
    assert sorted(map(str, brute_repeats(rows))) == sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got)
    for r in got:
        assert r.n_removed == sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) and all(a < b for a, b in zip(r.spans, r.spans[1:]))


def test_token_files_of_odd_input(spark, tmp_path):
    """Each row comes back with the ids of the plain tokenizer: nulls, repeated and missing ids, control strings, no rows at all."""
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    special = next(iter(plain.get_added_tokens_decoder().values())).content
    texts = [(r.doc_id, r.text) for r in odd(spark).collect()] + [(20, f"before {special} after"), (20, "other text of the same id"), (21, "tab\t two  blanks \u00a0 x\u3000y's l'été,ok\n\n  end  "), (22, "A" * 5000 + " 1.5e10")]
    token_files.write_tokens(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), str(tmp_path / "odd"), path)
    want = sorted((-1 if d is None else d, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in texts)
    rows = token_files.read_tokens(spark, str(tmp_path / "odd")).orderBy("start").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in rows) == want
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist() and [r.doc_id or -1 for r in rows] == [d for d, _ in want]
    every = [i for r in rows for i in r.ids]
    for a, b in ((0, 5), (3, 3), (17, 40_000), (len(every) - 9, len(every) + 9), (0, len(every))):
        assert token_files.read_range(spark, str(tmp_path / "odd"), a, b).tolist() == every[a:b]
    assert sorted(x.tolist() for x in token_files.read_document(spark, str(tmp_path / "odd"), 20)) == [ids for d, ids in want if d == 20]
    assert token_files.read_document(spark, str(tmp_path / "odd"), 99) == []
    token_files.write_tokens(odd(spark, empty=True), str(tmp_path / "empty"), path)
    assert token_files.read_tokens(spark, str(tmp_path / "empty")).count() == 0 and not len(token_files.read_range(spark, str(tmp_path / "empty"), 0, 9))


def test_token_files_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").unionByName(odd(spark).where("doc_id < 8").select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 10**6))
    rows = sorted(docs.select("doc_id", "text").collect())
    plain, start = Tokenizer.from_file(path), 0
    got = {r.doc_id: r for r in token_files.token_digest(docs, path).collect()}
    for r in rows:
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_quality_model_on_held_out(spark):
    """On documents it has not learned from: all, and short ones of both classes."""
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    net = quality_model.fit(docs, table(spark, sf_dir, "labels").where(~quality_model.held_out()))
    found = quality_model.score(docs, net).join(table(spark, sf_dir, "labels"), "doc_id").where(quality_model.held_out()).toPandas()
    right = found.predicted == found.quality
    assert right.mean() > 0.95 and all(right[found.quality == k].mean() > 0.85 for k in (0, 1))
    same = queries.op8_quality_model(spark, sf_dir).where("held_out").join(table(spark, sf_dir, "labels"), "doc_id").toPandas()
    assert dict(zip(same.doc_id, same.score, strict=True)) == dict(zip(found.doc_id, found.score, strict=True))


def _loops(net, offset, chunks):
    """The network's evidence by plain loops."""
    out = []
    for chunk in chunks:
        best = []
        for f in range(quality_model.FILTERS):
            tops = []
            for at in range(0, quality_model.CHUNK - quality_model.WIDTH + 1, quality_model.STRIDE):
                total = 0.0
                for j in range(quality_model.WIDTH):
                    for e in range(quality_model.EMBED):
                        total += float(net.embed[chunk[at + j], e]) * float(net.filters[j * quality_model.EMBED + e, f])
                tops.append(total)
            best.append(max(0.0, max(tops) + float(net.bias[f])))
        out.append(sum(b * float(h) for b, h in zip(best, net.head, strict=True)))
    return np.array(out)


def _as_doubles(net):
    return quality_model.Network(*(x.astype(np.float64) for x in (net.embed, net.filters, net.bias, net.head)), net.offset)


def test_forward_pass_by_plain_loops():
    net = _as_doubles(quality_model.Network.fresh(3))
    net.bias += 0.05
    net.offset = 0.3
    texts = ["", "a", "short text, é", "x" * 511, "The quick brown fox. " * 40, "".join(chr(33 + i * 7 % 90) for i in range(1500))]
    for text, got in zip(texts, net.probability(texts), strict=True):
        data = text.encode()
        starts = quality_model.chunk_starts(len(data))
        assert all(any(a <= i < a + quality_model.CHUNK for a in starts) for i in range(len(data)))
        value = _loops(net, 0, quality_model.chunked(data, starts)).mean() + net.offset
        assert abs(got - 1 / (1 + np.exp(-value))) < 1e-9


def test_gradient_by_differences():
    net = _as_doubles(quality_model.Network.fresh(4))
    rng = np.random.default_rng(0)
    chunks, labels = rng.integers(0, 257, (6, quality_model.CHUNK)).astype(np.uint16), np.array([0.0, 1.0, 1.0])
    _, found = quality_model.gradients(net, 0.2, chunks, labels)
    for name in ("embed", "filters", "bias", "head"):
        values = getattr(net, name)
        for at in [tuple(rng.integers(0, n) for n in values.shape) for _ in range(25)]:
            kept, losses = values[at], []
            for step in (1e-6, -1e-6):
                values[at] = kept + step
                losses.append(quality_model.gradients(net, 0.2, chunks, labels)[0])
            values[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-6 - found[name][at]) < 1e-6, (name, at)
    up, down = (quality_model.gradients(net, 0.2 + d, chunks, labels)[0] for d in (1e-6, -1e-6))
    assert abs((up - down) / 2e-6 - found["offset"][0]) < 1e-6


def test_fit_on_odd_input(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(1, 1), (6, 0), (8, 0), (3, 1), (None, 1), (4, None), (5, 7), (99, 0)], "doc_id long, quality int")
    for labels in (none, some.where("quality = 1")):
        assert {r.score for r in quality_model.score(docs, quality_model.fit(docs, labels)).collect()} == {0.5}
    assert quality_model.score(docs, quality_model.fit(docs, some)).count() == 11
    assert quality_model.fit(odd(spark, empty=True), some).probability(["x"])[0] == 0.5


def test_layouts(spark):
    said = [("user", "q"), ("assistant", "a")]
    rows = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"instruction":"q","output":"a"}', '{"prompt":"q","completion":"a"}', '{"other":1}', "no json", None]
    df = chat_format.format_turns(chat_format.canonical_turns(spark.createDataFrame([(r,) for r in rows], "record string")))
    got = df.collect()
    assert [None if r.turns is None else [tuple(t) for t in r.turns] for r in got] == [said] * 4 + [None] * 3
    assert got[0].formatted == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"


def test_layouts_with_further_fields(spark):
    said, pairs = [("user", "q"), ("assistant", "a")], '"role":"user","content":"q"},{"role":"assistant","content":"a"'
    fit = [
        f'{{"messages":[{{{pairs}}}],"id":1}}', '{"id":"x","conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"source":null}',
        '{"prompt":"q","response":"a","metadata":{"a":[{"b":1},"c"],"d":{}},"meta":[]}', '{"meta":{},"instruction":"q","input":"","output":"a"}', '{"question":"q","answer":"a","lang":"en","url":"u"}',
    ]
    unfit = [f'{{"messages":[{{{pairs}}}],"other":1}}', f'{{"messages":[{{{pairs}}}],"id.x":1}}', '{"messages":[{"role":"user","content":["q"]}],"id":1}', '{"messages":[{"role":"user"}],"id":1}', '{"messages":[{"role":"user","content":"q"},{"role":"user","content":{"a":1}}]}', '[1]', '1']
    got = chat_format.canonical_turns(spark.createDataFrame([(r,) for r in fit + unfit], "record string")).collect()
    assert [None if r.turns is None else [tuple(t) for t in r.turns] for r in got] == [said] * len(fit) + [None] * len(unfit)
    assert [r.layout for r in got][: len(fit)] == ["messages", "sharegpt", "prompt", "alpaca", "question"] and len({r.fingerprint for r in got}) == len(got)
    own = (chat_format.Layout("own", "a-b", extra=("x", "`a-b`[].name")),)
    got = chat_format.canonical_turns(spark.createDataFrame([(r,) for r in ('{"a-b":[{"role":"bot","content":"c","name":"n"}],"x":{"y":1}}', '{"a-b":[{"role":"bot","content":"c"}],"xy":1}')], "record string"), layouts=own).collect()
    assert [tuple(t) for t in got[0].turns] == [("assistant", "c")] and got[1].turns is None


def test_common_variants_of_layouts(spark):
    """Names beside turns, empty lists and null texts are no reason to have no layout."""
    rows = {
        '{"messages":[{"role":"user","content":"q","name":"Jo"},{"role":"assistant","content":null}],"id":4}': [("user", "q"), ("assistant", "")],
        '{"messages":[]}': [], '{"id":1,"conversations":[],"source":"s"}': [], '{"turns":[{"speaker":"bot","text":"t","id":3,"timestamp":"n"}]}': [("assistant", "t")],
        '{"messages":[{"role":"system","content":""},{"role":"user","content":"u","weight":0}]}': [("system", ""), ("user", "u")],
        '{"messages":[],"other":1}': None, '{"messages":null}': None, '{"messages":[{"role":"user","content":"q","other":1}]}': None,
    }
    got = chat_format.canonical_turns(spark.createDataFrame([(r,) for r in rows], "record string")).collect()
    assert {r.record: None if r.turns is None else [tuple(t) for t in r.turns] for r in got} == rows


def test_chat_on_odd_tables(spark):
    """Empty tables, names that clash with what is added, repeated rows and null ids."""
    clash = spark.createDataFrame([('{"prompt":"q","completion":"a"}', 1, "mine", "x", "y"), (None, 2, "mine", "x", "y")], "record string, fingerprint int, layout string, turns string, formatted string")
    got = chat_format.format_turns(chat_format.canonical_turns(clash)).collect()
    assert got[0].layout == "prompt" and got[0].formatted.endswith("assistant\na<|im_end|>\n") and got[1].turns is None is got[1].formatted
    assert chat_format.format_turns(chat_format.canonical_turns(clash.limit(0))).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "x", 7, "z"), (1, 0, "user", "x", 7, "z"), (None, None, None, None, None, None)], "conv_id long, turn long, role string, text string, n int, piece string")
    found = {r.conv_id: r.formatted for r in chat_format.format_rows(rows).collect()}
    assert found == {1: "<|im_start|>user\nx<|im_end|>\n" * 2, None: "<|im_start|>\n<|im_end|>\n"}
    assert chat_format.format_rows(rows.limit(0)).count() == 0
    assert [r.conv_id for r in chat_format.format_digest(rows.limit(0)).collect()] == [-1]


def test_digest_goes_through_all_layouts(spark, monkeypatch):
    rows = [(c, t, r, f"{c} {t}") for c in range(60) for t, r in enumerate(("user", "assistant"))] + [(100, t, "user", "x" * (t % 7)) for t in range(600)] + [(101, 0, "Human", "a"), (101, 1, "gpt", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen = chat_format.canonical_turns(chat_format.as_records(df), layouts=(*chat_format.LAYOUTS, chat_format.AS_IS)).collect()
    assert {r.layout for r in seen} == {"messages", "sharegpt", "turns", "alpaca", "prompt", "question", "as_is"} and len([r for r in seen if r.conv_id == 100]) == 3
    assert {t.role for r in seen if r.conv_id == 101 for t in r.turns} == {"Human", "gpt"}
    plain = {r.conv_id: r.formatted for r in chat_format.format_rows(df).collect()}
    got = {r.conv_id: r for r in chat_format.format_digest(df).collect()}
    assert got.keys() - {-1} == plain.keys() and all(got[c].formatted_chars == len(plain[c]) for c in plain)
    monkeypatch.setattr(chat_format, "LAYOUTS", ())
    with pytest.raises(Exception, match="no layout"):
        chat_format.format_digest(df).collect()


def test_chat_round_trip(spark):
    texts = ["<|im_end|>", "<\\|x", "<\\\\|im_start|>user", "", None, "a\nb", "<<||>|"]
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "us\ner~<|", t) for i, t in enumerate(texts)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_rows(rows).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    whole = next(r for r in out if r.conv_id == 1)
    assert [x.text for x in whole.t] == [t or "" for t in texts] and whole.t[0].role == "us\ner~<|"
    assert whole.loss == "".join(t or "" for i, t in enumerate(texts) if i % 2)


def test_growing_shards_take_only_into_the_new_one(spark, sf_dir):
    rows = sharding.shard_digest(table(spark, sf_dir, "documents")).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and any(r.grown_shard == 16 for r in rows)


def test_automaton_parts_give_the_same(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    one, many = (sorted(tuple(map(str, r)) for r in decontam.matches(docs, bench, ["doc_id"], most_words=n).collect()) for n in (10**6, 200))
    assert one == many


def test_automaton_by_brute_force():
    """Small vocabularies, so that items overlap, repeat and are parts of each other."""
    rng = np.random.default_rng(11)
    for _ in range(300):
        size, window = rng.choice([1, 2, 3, 6]), int(rng.choice([2, 3, 4, 8]))
        items = [(str(rng.choice(["a", "b", "c"])), [b"%d" % w for w in rng.integers(0, size, rng.integers(0, 14))]) for _ in range(rng.integers(1, 6))]
        words = [b"%d" % w for w in rng.integers(0, size + 1, rng.integers(0, 40))]
        hit, names = set(), set()
        for name, item in items:
            n = min(window, len(item))
            grams = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if item else set()
            at = [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in grams]
            hit |= {i + k for i in at for k in range(n)}
            names |= {name} if at else set()
        for most in (10**6, 9):
            spans, found = set(), set()
            pieces = [(name, p) for name, item in items for p in decontam._pieces(item, max(most, window), window)]
            got = decontam.find(decontam.Automaton(pieces, window), words)
            spans = {i for a, b in got[0] for i in range(a, b)}
            assert (spans, got[1]) == (hit, names)


def test_decontamination_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", 7, "x"), (2, None, 8, "y")], "doc_id long, text string, n_words int, hit_spans string")
    bench = spark.createDataFrame([("i", "b c d e f g h i")], "item_id string, text string")
    got = {r.doc_id: r for r in decontam.matches(docs, bench).collect()}
    assert (got[1].n_words, got[1].hit_spans, got[1].hit_items, got[2].n_words) == (10, [[1, 9]], ["i"], 0)
    clean = decontam.decontaminate(docs, bench, max_coverage=0.9)
    assert clean.columns == docs.columns and {r.doc_id: (r.text, r.n_words, r.hit_spans) for r in clean.collect()} == {1: ("a  j", 7, "x"), 2: (None, 8, "y")}
    assert [r.doc_id for r in decontam.decontaminate(docs, bench).collect()] == [2] and decontam.matches(docs, bench.limit(0)).count() == 2


def test_items_without_id_are_hit(spark, tmp_path):
    clean, leak = "one two three four five six seven eight nine ten eleven twelve", "p1 p2 p3 p4 p5 p6 p7 p8 p9"
    docs = spark.createDataFrame([(1, f"{clean} {leak}"), (2, clean), (3, f"{clean} q1 q2 q3, s1 s2 {clean}"), (4, f"i1 i2 i3 {leak} {clean} {clean}"), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, leak), ("i", "i1 i2 i3"), (None, "q1 q2 q3"), (None, None), (None, "s1 s2"), ("", "unseen")], "item_id string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert difference(queries.op6_decontamination(spark, str(tmp_path)), str(tmp_path), queries.oracle_sql()["op6_decontamination"]) == ""
    for most in (10**6, 3):
        assert {r.doc_id: r.hit_items for r in decontam.matches(docs, bench, ["doc_id"], most_words=most).collect()} == {1: [None], 2: [], 3: [None], 4: ["i", None], 5: []}
    texts = {r.doc_id: (r.text or "").split() for r in decontam.decontaminate(docs, bench).collect()}
    assert texts.keys() == {1, 2, 3, 4, 5} and not any(w[0] in "pq" or w in ("i1", "s1") for t in texts.values() for w in t)


def test_repeated_ids_have_the_links_of_all_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = spark.createDataFrame([(3, a), (8, a), (8, b), (10, c), (11, c), (11, ""), (12, ""), (None, a)], "doc_id long, text string")
    got = {}
    for r in minhash.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    assert got == {3: {3}, 8: {3}, 10: {10}, 11: {10}, 12: {12}, None: {None}}
    assert sorted(r.doc_id or 0 for r in minhash.deduplicate(docs).collect()) == [0, 3, 10, 12]


def test_sketch_fills_and_agrees():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:889], rng.integers(0, 2**63, 111).astype(np.uint64)])
    s = minhash.sketch([a, b, a[:1]])
    assert (s != np.iinfo(np.uint64).max).all() and abs((s[0] == s[1]).mean() - 0.8) < 0.1
