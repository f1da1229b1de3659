"""The pipeline against a brute-force version of its decisions."""

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from parlance.llm import common, language_id

from test_documents import ROWS, brute_mix, check_packing, components, frame


def test_stages_on_hard_rows(spark):
    docs = frame(spark).select(*corpus_pipeline.COLUMNS)
    model = language_id.fit(docs)
    stage = dict(corpus_pipeline.STAGES)
    key = lambda r: (r[0], r[1])

    kept = stage["language_id"](spark, docs, "")
    rows = [r for r in ROWS if max(model.infer(r[1]).values(), default=0) >= corpus_pipeline.LEAST_SHARE]
    assert Counter(map(key, kept.collect())) == Counter(map(key, rows))
    assert all(r.lang == model.best(r.text)[0] for r in kept.collect())

    kept = stage["exact_dedup"](spark, kept, "")
    top = {}
    for r in rows:
        if r[1] not in top or (top[r[1]][0] is None or r[0] is not None and r[0] > top[r[1]][0]):
            top[r[1]] = r
    rows = list(top.values())
    assert Counter(map(key, kept.collect())) == Counter(map(key, rows))

    kept = stage["ngram_jaccard_join"](spark, kept, "")
    comp = components(rows)
    rows = [r for r in rows if comp.get(r[0]) == r[0]]
    assert Counter(map(key, kept.collect())) == Counter(map(key, rows))

    mixed = stage["mixing"](spark, kept, "").collect()
    sizes, total, target = brute_mix(rows)
    size = {r[0]: n for n, r in zip(sizes, rows)}
    words = Counter()
    for r in mixed:
        words[r.source] += size[r.doc_id]
    largest = defaultdict(int)
    for n, r in zip(sizes, rows):
        largest[r[3]] = max(largest[r[3]], n)
    assert all(target[s] - 1 <= words[s] <= target[s] + largest[s] for s in total)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3

    again = spark.createDataFrame(mixed, docs.schema)
    check_packing([tuple(r)[:4] for r in mixed], stage["packing"](spark, again, "").collect())


def test_run_on_table(spark, sf_dir):
    """All five stages against brute force on the table."""
    got = corpus_pipeline.run(spark, sf_dir).collect()
    docs = common.read_table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    rows = [r for r in rows if max(model.infer(r[1]).values(), default=0) >= corpus_pipeline.LEAST_SHARE]
    top = {}
    for r in rows:
        top[r[1]] = max(top.get(r[1], r), r, key=lambda x: x[0])
    rows = list(top.values())
    comp = components(rows)
    rows = [r for r in rows if comp[r[0]] == r[0]]
    text = {r[0]: r for r in rows}

    taken = Counter(p.doc_id for p in got if p.start == 0)
    assert set(taken) <= set(text) and max(taken.values()) <= 3
    sizes, total, target = brute_mix(rows)
    size, words, largest = {r[0]: n for n, r in zip(sizes, rows)}, Counter(), Counter()
    for i, n in taken.items():
        words[text[i][3]] += n * size[i]
    for n, r in zip(sizes, rows):
        largest[r[3]] = max(largest[r[3]], n)
    assert all(target[s] - 1 <= words[s] <= target[s] + largest[s] for s in total)
    check_packing([text[i] for i, n in taken.items() for _ in range(n)], got)


def test_mixtures_without_a_main_language_go(spark):
    r = np.random.default_rng(1)
    make = {"en": ["the", "thing", "ation", "er"], "fr": ["è", "eau", "que", "ç"], "de": ["sch", "ung", "zu", "ß"]}
    say = lambda lang, n: " ".join("".join(r.choice(make[lang], 2)) for _ in range(n))
    rows = [(i, say(list(make)[i % 3], 30), list(make)[i % 3], "a") for i in range(240)]
    rows += [(900, " ".join(say(lang, 60) for lang in make), None, "a"), (901, say("fr", 60), None, "a"), (902, "", "en", "a")]
    docs = frame(spark, rows).select(*corpus_pipeline.COLUMNS)
    kept = {x.doc_id: x for x in corpus_pipeline.language(spark, docs, "").collect()}
    assert 900 not in kept and 902 not in kept and kept[901].lang == "fr" and len(kept) == 241


def test_empty_table(spark, tmp_path):
    frame(spark, []).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
