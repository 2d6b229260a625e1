"""The pipeline's stages, each written and read again, against a brute-force version of each."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from math import floor, log

import pytest

import corpus_pipeline
from boughs.llm import quality_model

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def small(spark, sf_dir):
    """All documents of the smallest tables, and rows with nulls, repeats, benchmark passages and copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len((r.text or "").split()) > 12]
    first = docs.where("length(text) > 900").orderBy("doc_id").first()
    words = first.text.split(" ")
    more = [
        (900_001, f"{first.text} {items[0]}", first.lang, first.source, 0), (900_002, items[1], "en", "web", 0), (900_003, first.text, None, None, None),
        (900_004, " ".join([*words[: len(words) // 2], "and", "then", *words[len(words) // 2 :]]), first.lang, None, 0), (900_005, None, None, None, None), (900_006, "", "en", None, 0),
    ]
    return docs.unionByName(spark.createDataFrame(more, docs.schema))


def classified(rows, net):
    """Each text by itself, so that no text depends on what it is scored with."""
    return [r for r in rows if net.probability([r["text"] or ""])[0] >= 0.5]


def deduplicated(rows):
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    with_gram = defaultdict(list)
    for i, grams in sets.items():
        for g in grams:
            with_gram[g].append(i)
    pairs = {(a, b) for ids in with_gram.values() for a in ids for b in ids if a < b}
    for a, b in sorted(pairs):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {k: new if v == old else v for k, v in label.items()}
    return [r for r in rows if label[r["doc_id"]] == r["doc_id"]]


def decontaminated(rows, items):
    word = re.compile(rb"[0-9a-z\x80-\xff]+")
    windows = defaultdict(set)
    for item in items:
        w = word.findall((item or "").encode().lower())
        n = min(8, len(w))
        windows[n] |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    out = []
    for r in rows:
        data = (r["text"] or "").encode()
        places = [m.span() for m in word.finditer(data.lower())]
        w = [data.lower()[a:b] for a, b in places]
        hit = {i + k for n, grams in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams for k in range(n)}
        if len(hit) > 0.5 * len(w):
            continue
        if hit:
            # The words of a stretch go with what stands between them.
            gone = bytearray(len(data))
            for i in hit:
                a, b = places[i][0], places[i + 1][0] if i + 1 in hit else places[i][1]
                gone[a:b] = b"\x01" * (b - a)
            text = bytes(c for c, g in zip(data, gone, strict=True) if not g).decode()
            r = r | {"text": text, "n_chars": len(text)}
        out.append(r)
    return out


def mixed(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append((r, len(WORDS.findall(r["text"] or ""))))
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for _, n in by_source[s]) for s in names}
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        share = {s: left * weight[s] / sum(weight[t] for t in names if t not in full) for s in names if s not in full}
        over = {s for s in share if share[s] >= 3 * total[s]}
        target = {s: 3.0 * total[s] if s in full else share[s] for s in names}
        if not over:
            break
        full |= over
    out = []
    for s in names:
        ratio = target[s] / total[s] if total[s] else 0.0
        start = int(md5((s if s is not None else "\x00") + "/0")[:12], 16) / 16**12

        def place(x):
            digest = md5(f"{x[0]['doc_id']}/0")
            bits = f"{x[1]:b}"
            return f"{len(bits):02d}{bits[:4]:0<4}{digest[:2]}", digest

        for k, (r, _) in enumerate(sorted(by_source[s], key=place)):
            out += [r] * min(3, floor(start + ratio * (k + 1)) - floor(start + ratio * k))
    return out


def sharded(rows):
    def shard(r):
        draw = lambda s: (int(md5(f"{r['doc_id']}/{s}")[:13], 16) + 0.5) / 16**13
        return min(range(16), key=lambda s: (-log(draw(s)), s))

    by_shard = defaultdict(list)
    for r in rows:
        by_shard[shard(r)].append(r)
    return [r | {"shard": s, "slot": i} for s, held in by_shard.items() for i, r in enumerate(sorted(held, key=lambda r: md5(str(r["doc_id"]))))]


def counted(rows):
    return Counter(tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows)


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    small(spark, sf_dir).write.parquet(str(folder / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def test_all_stages_by_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    rows = [r.asDict() for r in docs.collect()]
    net = quality_model.fit(docs, spark.read.parquet(f"{tables}/labels.parquet").where(~quality_model.held_out()))
    items = [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    brute = {"quality_classifier": lambda x: classified(x, net), "near_dedup": deduplicated, "decontamination": lambda x: decontaminated(x, items), "mix_sources": mixed, "shard": sharded}
    assert [name for name, _ in corpus_pipeline.STAGES] == list(brute)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        before, rows = len(rows), brute[name](rows)
        got = [r.asDict() for r in docs.collect()]
        assert rows and counted(got) == counted(rows), name
        assert name == "shard" or (docs.columns == columns and len(rows) != before), name
    # The whole run gives these rows as well.
    assert counted(r.asDict() for r in corpus_pipeline.run(spark, tables).collect()) == counted(rows)


def test_planted_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    stay = {r.doc_id for r in stages["near_dedup"](spark, docs, tables).collect()}
    assert {900_003, 900_004}.isdisjoint(stay) and {900_002, 900_005, 900_006} <= stay
    clean = {r.doc_id: r.text for r in stages["decontamination"](spark, docs, tables).collect()}
    assert 900_002 not in clean and clean[900_005] is None and len(clean[900_001].split()) < len(docs.where("doc_id = 900001").first().text.split())


def test_stages_on_odd_tables(spark, tables):
    """No rows, and rows that repeat or hold nulls alone."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    nothing = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(5, "", "en", "s", 0)] * 2 + [(5, "five words in a row", "en", "s", 0)] * 2, docs.schema)
    kept = {"quality_classifier": None, "near_dedup": 3, "decontamination": 6, "mix_sources": None, "shard": 6}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tables).count() == 0, name
        n = stage(spark, nothing, tables).count()
        assert kept[name] in (None, n), (name, n)
