import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from roadlens.llm import toxicity
from roadlens.llm.common import durable

from ..conftest import DATA
from .test_dedup import WORDS, brute_components, line_set, smallest_reachable


def test_stages_on_hard_rows(spark, hard, empty):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (hard.select(*names), empty.select(*names), hard):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = durable(stage(spark, docs, DATA))
            if k < 4:
                assert docs.columns == columns


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()
    assert out.groupBy("doc_id").count().where("count > 2").count() == 0


def deduped(docs):
    """Texts by doc_id with only the first of all lines that are near to one another, by brute force."""
    lines = [(i, k, x) for i, t in docs for k, x in enumerate((t or "").split("\n")) if re.search(WORDS, x)]
    different = sorted({x for _, _, x in lines})
    sets, found = [line_set(x) for x in different], defaultdict(set)
    for k, s in enumerate(sets):
        for g in s:
            found[g].add(k)
    links = {(a, b) for ids in found.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in links if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    number = {different[k]: c for k, c in smallest_reachable(range(len(different)), links).items()}
    first, gone = {}, defaultdict(set)
    for i, k, x in sorted(lines):
        if first.setdefault(number[x], (i, k)) != (i, k):
            gone[i].add(k)
    return {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs}


def shares(size, weights=(5, 2, 1)):
    """Targets of sources of so many words: 150 % by weight, at most twice the source, the rest shared again."""
    names = sorted((n for n in size if n is not None)) + ([None] if None in size else [])
    weight = {n: weights[k % 3] for k, n in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if weight[n] * level > 2 * size[n]}
        for n in full or open_:
            target[n] = 2 * size[n] if full else weight[n] * level
            left -= target[n]
        open_ -= full or set(open_)
    return target


def test_stages_against_brute_force(spark):
    """Each stage on what the one before it kept, with rows that are near copies, unspaced and alone in a source."""
    given = spark.read.parquet(f"{DATA}/documents.parquet")
    base = " ".join(f"plain{i % 97}x{i}" for i in range(90))
    more = [(900_000, base, "en", "web", 1), (900_001, base.replace("plain5x5", "other"), "en", "web", 1), (900_002, "字" + "".join(chr(0x4E00 + 13 * i) for i in range(300)), "zh", None, 1),
            (900_003, "".join(chr(0x4E00 + 13 * i) for i in range(300)), "zh", None, 1), (900_004, None, None, None, None), (900_005, "", "en", "alone", 0)]
    docs = durable(given.unionByName(spark.createDataFrame(more, given.schema)))
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    clean = durable(stages["toxicity"](spark, docs, DATA))
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where(~toxicity.held_out("doc_id"))
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert sorted(rows(clean), key=repr) == sorted(((r["doc_id"], r["text"]) for r in scored if r["score"] < 0.3), key=repr)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    assert {r[0] for r in more} <= {i for i, _ in rows(clean)} and sum(i in toxic for i, _ in rows(clean)) <= 0.3 * len(toxic)

    lines = durable(stages["line dedup"](spark, clean, DATA))
    got, want = dict(rows(lines)), deduped(rows(clean))
    assert set(got) == set(want) and sum(got[i] != want[i] for i in want) <= 0.02 * len(want)
    assert got[900_001] == "" and got[900_003] == "" and got[900_004] is None

    alone = durable(stages["n-gram Jaccard join"](spark, lines, DATA))
    sets, of = brute_components(rows(lines))
    assert sorted(rows(alone), key=repr) == sorted(((i, t) for i, t in rows(lines) if of[i] == i), key=repr)

    mixed = durable(stages["mixing sources"](spark, alone, DATA))
    words = {r["doc_id"]: (r["source"], len(re.findall(WORDS, r["text"] or ""))) for r in alone.collect()}
    size, most = Counter(), Counter()
    for s, n in words.values():
        size[s] += n
        most[s] = max(most[s], n)
    taken, copies = Counter(), Counter(i for i, _ in rows(mixed))
    assert set(copies) <= set(words) and max(copies.values()) <= 2 and dict(rows(mixed)).items() <= dict(rows(alone)).items()
    for i, n in copies.items():
        taken[words[i][0]] += n * words[i][1]
    for s, target in shares(size).items():
        assert abs(taken[s] - target) <= most[s], (s, taken[s], target)

    out = stages["BPE"](spark, mixed, DATA).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    texts = dict(rows(mixed))
    assert Counter(r["doc_id"] for r in out) == copies
    for r in out:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
