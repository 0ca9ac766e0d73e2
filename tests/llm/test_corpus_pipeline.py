"""The pipeline against a plain version of its stages."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline

WORDS = {"en": ["the", "reader", "has", "words", "of", "paper"], "de": ["der", "leser", "hat", "wörter", "vom", "blatt"]}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(n))


def tables(spark, folder, docs, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(d, t, lang, s, len(t or "")) for d, t, lang, s in docs]
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain(docs, items):
    """Documents that stay, with what the mix takes of them; assumes ids are unique."""
    kept = {d: (t, s) for d, t, _, s in docs if t and re.search(r"[^\W\d_]", t)}
    root = {d: d for d in kept}
    sets = {d: shingles(t) for d, (t, _) in kept.items()}

    def find(d):
        return d if root[d] == d else find(root[d])

    for a in sorted(kept):
        for b in sorted(kept):
            shared = len(sets[a] & sets[b])
            if a < b and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {d: v for d, v in kept.items() if find(d) == d}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for _, t in items:
        ws = word.findall(t.lower())
        windows |= {tuple(ws[k : k + 13]) for k in range(len(ws) - 12)}
    for d, (t, _) in list(kept.items()):
        ws = word.findall(t.lower())
        hit = {k + j for k in range(len(ws) - 12) if tuple(ws[k : k + 13]) in windows for j in range(13)}
        if hit and 20 * len(hit) >= len(ws):
            del kept[d]
    kept = {d: (re.sub(r"token = [0-9a-z]{8,}", "[SECRET]", t), s) for d, (t, s) in kept.items()}
    size = {d: len(t.split()) for d, (t, _) in kept.items()}
    totals = Counter()
    for d, (_, s) in kept.items():
        totals[s] += size[d]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(totals))}
    target, open_, rest = {}, set(totals), sum(totals.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * totals[s] <= level * weight[s]}
        target |= {s: 3 * totals[s] for s in full} if full else {s: level * weight[s] for s in open_}
        rest -= sum(3 * totals[s] for s in full)
        open_ = open_ - full if full else set()
    out = {}
    for source in totals:
        at, budget = 0, int(target[source] + 0.5)
        mine = sorted((d for d in kept if kept[d][1] == source), key=lambda d: (hashlib.md5(f"mix-1:{d}".encode()).hexdigest(), d))
        for d in mine:
            left = budget % totals[source] - at
            taken = budget // totals[source] * size[d] + max(0, min(left, size[d]))
            at += size[d]
            if taken:
                out[d] = (kept[d][0], source, taken)
    return out


def test_run_equals_the_plain_version(spark, tmp_path):
    rng = random.Random(6)
    docs = [(i, prose(rng, lang, rng.randrange(20, 90)), lang, rng.choice("abc")) for i in range(60) for lang in [rng.choice(["en", "de"])]]
    items = [(i, prose(rng, "en", 30)) for i in range(3)]
    for i in range(8):
        d = rng.randrange(60)
        words = docs[d][1].split()
        words[rng.randrange(len(words))] = "other"
        docs.append((100 + i, " ".join(words), docs[d][2], "b"))
    docs += [(200, None, "en", "a"), (201, "", "en", "a"), (202, "12 %% !", "en", "a"), (203, docs[0][1], "en", "c")]
    docs += [(300 + i, f"{prose(rng, 'en', 20)} {t} {prose(rng, 'en', 9)}", "en", "c") for i, t in items]
    docs += [(400, f"{prose(rng, 'en', 20)} token = abcdefgh12 {prose(rng, 'en', 9)}", "en", "a")]
    folder = tables(spark, tmp_path, docs, items)
    got = corpus_pipeline.run(spark, folder)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = got.collect()
    assert {r.doc_id: (r.text, r.source, r.taken) for r in rows} == plain(docs, items)
    assert len(rows) == len({r.doc_id for r in rows}) and all(r.n_chars == len(r.text) for r in rows)


def test_texts_in_scripts_that_no_language_uses_go(spark, tmp_path):
    rng = random.Random(9)
    docs = [(i, prose(rng, lang, 40), lang, "a") for i in range(20) for lang in [("en", "de")[i % 2]]]
    foreign = {100: "мы живём в большом городе у реки " * 5, 101: "我们住在河边的大城市里" * 9, 102: f"{prose(rng, 'en', 4)} " + "мы живём в большом городе " * 9}
    mixed = {200: f"{prose(rng, 'en', 40)} мы живём в городе"}
    docs += [(d, t, None, "a") for d, t in (foreign | mixed).items()]
    folder = tables(spark, tmp_path, docs, [])
    got = corpus_pipeline.identify_language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert {r.doc_id for r in got.collect()} == {d for d, *_ in docs} - set(foreign)


def test_texts_that_share_a_doc_id_stay(spark):
    rng = random.Random(10)
    a, b, c, d = (prose(rng, "en", 60) for _ in range(4))
    near = " ".join(["other", *a.split()[1:]])
    rows = [(9, a, "x"), (9, b, "x"), (9, b, "x"), (9, b, "w"), (12, near, "x"), (5, c, "x"), (5, near, "x"), (20, d, "x"), (None, a, "x"), (2**63 - 1, c, "x"), (-(2**63), d, "x")]
    want = Counter([(9, b, "w"), (5, c, "x"), (5, near, "x"), (-(2**63), d, "x"), (None, a, "x")])
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)
        assert Counter(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())) == want


def test_stages_take_empty_tables_nulls_and_repeated_rows(spark, tmp_path):
    rng = random.Random(8)
    text = prose(rng, "en", 40)
    docs = [(1, text, "en", "a"), (1, text, "en", "a"), (None, prose(rng, "de", 40), None, None), (2, None, None, None)]
    folder = tables(spark, tmp_path / "some", docs, [(1, None), (None, "x")])
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == Counter([1, None])
    folder = tables(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "source_mixing"]
