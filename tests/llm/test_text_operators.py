import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contextloom.llm import components, decontam, jaccard, mixing, quality, substrings
from contextloom.llm.components import Labels
from contextloom.llm.shared import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" + r.choice(["", ",", "."]) for _ in range(n)]


def corpus():
    """Copies, near copies, shared passages, repeats, nulls, blanks, long texts and ties."""
    base, passage = words(300, 1), words(70, 2)
    texts = [None, "", "  \n\t ", "one", "one two three", "one two three", " ".join(base), " ".join(base)]
    for k in range(60):  # near copies, more than a list of rare tokens may have
        near = list(base)
        for j in range(k % 9):
            near[(37 * k + 53 * j) % 300] = f"edit{k}x{j}"
        texts.append(" ".join(near[: 300 - 20 * (k % 3 == 1)]))
    for k in range(40):
        own = words(40 + 5 * k, 100 + k)
        texts.append(" ".join(own[:20] + passage + own[20:]))
    texts += ["a b c d " * 2000, "line\nline\nline\n" + " ".join(words(200, 7)), "x " * 60, " ".join(words(20000, 9, 100000)), "#$% " * 100, "é ñ ü ß " * 30]
    return [(i, t, ["en", "de", None][i % 3], ["hot", "b", None, "c"][0 if i % 3 else i % 4], 0 if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame(corpus(), DOCS).repartition(4), "test")


def test_quality_counts(spark, docs):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert len(got) == docs.count()
    for i, text, *_ in corpus():
        text = text or ""
        ws, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        often = collections.Counter(zip(ws, ws[1:], ws[2:], strict=False))
        covered = {k for j, w in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if often[w] > 1 for k in (j, j + 1, j + 2)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws))
        assert not (r.base_failed and r.kept)


def test_quality_clashing_columns_and_empty_tables(spark, docs):
    odd = docs.withColumn("kept", F.lit("x")).withColumn("N_words", F.lit("y")).withColumn("_row", F.lit(1))
    out = quality.quality_rules(odd)
    assert dict(out.dtypes)["kept"] == "boolean" and "_row" in out.columns
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_quality_divergence(spark):
    r = random.Random(3)
    prose = [" ".join(r.choice(["the", "of", "and", "to", "in", "that", "word", "house", "tree"]) + r.choice("abcdefgh") * r.randrange(2) for _ in range(300)) for _ in range(20)]
    junk = " ".join("".join(r.choice("#$%&|<>") for _ in range(6)) for _ in range(300))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*prose, junk])], "doc_id long, text string, lang string")
    got = {x.doc_id: x.kept for x in quality.quality_rules(df).collect()}
    assert all(got[i] for i in range(20)) and not got[20]


def test_quality_of_other_languages(spark):
    r = random.Random(5)
    prose = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 9))) for _ in range(n))
    english = [" ".join(r.choice(["the", "of", "and", "to", "in", "that", "word", "house", "tree"]) + r.choice("abcdefgh") * r.randrange(2) for _ in range(300)) for _ in range(9)]
    chinese, polish = prose([chr(0x4E00 + k) for k in range(900)], 300), prose("aąbcćdeęłmnńoóprsśtuwyzźż", 300)
    rows = [(i, t, "en") for i, t in enumerate(english)]
    rows += [(20, chinese, "zh"), (21, polish, "pl"), (22, "dobry " * 300, "pl"), (23, prose("abc", 20), "pl"), (30, chinese, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in quality.quality_rules(df).collect()}
    assert [i for i in [*range(9), 20, 21] if not got[i].kept] == []
    # base rules hold for all, and what is not labelled is held against the references
    assert not any(got[i].kept for i in (22, 23, 30)) and got[22].base_failed and got[23].base_failed and not got[30].base_failed


def test_substrings_against_brute_force(spark, docs):
    got = {r.doc_id: r for r in substrings.deduplicate_substrings(docs).collect()}
    first: dict = {}
    for i, text, *_ in corpus():
        ws = WORD.findall(text or "")
        runs = [tuple(ws[k : k + 50]) for k in range(len(ws) - 49)]
        gone = {j for k, run in enumerate(runs) if first.get(run, i) < i for j in range(k, k + 50)}
        for run in runs:
            first.setdefault(run, i)
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(ws), len(gone), kept), i
        assert sum(s.words for s in got[i].spans) == len(gone)
    assert substrings.deduplicate_substrings(docs.limit(0)).count() == 0


def test_factors_name_their_sources(spark, docs):
    text = {r[0]: WORD.findall(r[1] or "") for r in corpus()}
    for r in substrings.deduplicate_substrings(docs).collect():
        ws, at = text[r.doc_id], 0
        for f in r.factors:
            assert f.start >= at and f.source < r.doc_id
            assert ws[f.start : f.start + f.words] == text[f.source][f.source_start : f.source_start + f.words]
            at = f.start + f.words
        assert sum(f.words for f in r.factors) == r.n_removed


def test_substrings_with_ties_and_null_ids(spark):
    text = " ".join(words(80, 5))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = [(r.doc_id, r.n_removed) for r in substrings.deduplicate_substrings(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (None, 0), (2, 80)], key=str)


def brute_components(rows, size=4, percent=85):
    sets, root = {}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text, *_ in rows:
        ws = WORD.findall((text or "").translate(low))
        sets[i] = {tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))} if ws else set()
        root[i] = i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_against_brute_force(spark, docs):
    # few frequent tokens make long lists, so both kinds of keys and the rounds over heads are used
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard.link_documents(docs, frequent=4).collect()}
    assert got == brute_components(corpus())


def family(n=160):
    """A large group of near copies of several kinds: edits of their own, edits that many share, cut ends, copies of copies."""
    base, out = words(120, 11), []
    for k in range(n):
        r, ws = random.Random(500 + k), list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            ws[r.randrange(120)] = f"own{k}x{r.randrange(99)}" if r.random() < 0.6 else f"shared{r.randrange(5)}"
        ws = ws[: r.choice([120, 120, 118, 110, 100])]
        if k % 3 == 2 and out:
            ws = list(r.choice(out))
            ws[r.randrange(len(ws))] = f"later{k}"
        out.append(ws)
    return [" ".join(ws) for ws in out]


def test_jaccard_divides_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRED", 4)
    rows = [(i, t, None, None, 0) for i, t in enumerate(family())]
    df = materialize(spark.createDataFrame(rows, DOCS), "test")
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard.link_documents(df, frequent=6, sent_tokens=0).collect()}
    assert got == brute_components(rows)
    assert 2 < len({c for _, c in got.values()}) < 100


def test_whole_sets_leave_texts_in_place(spark, monkeypatch):
    """Sets of some documents, without an exchange of all texts; by a join beyond a bound, with the same result."""
    a, b = " ".join(words(60, 31)), " ".join(words(60, 32))
    docs = materialize(spark.createDataFrame([(1, a), (2, b), (2, b), (2, a), (3, a), (4, None), (5, "")], "doc long, text string"), "test")
    sets = {t: tokens for t, (_, tokens) in zip((a, b), jaccard.shingle_sets(pa.array([a, b]), 4), strict=True)}
    node = lambda doc, rep, t, rows: (doc, rep, len(sets[t]), *jaccard.set_sums(sets[t]), rows)
    columns = "doc long, rep long, n int, c1 long, c2 long, rows long"
    for nodes in ([node(1, 1, a, 1), node(77, 2, a, 1)], [node(1, 1, a, 1), node(77, 2, a, 1), node(2, 2, b, 2)], []):
        for sent in (0, 100):
            monkeypatch.setattr(jaccard, "SENT_NODES", sent, raising=False)
            found = jaccard.full_sets(docs, spark.createDataFrame(nodes, columns), 4)
            got = sorted((r.doc, r.n, sorted(r.tokens)) for r in found.collect())
            assert got == sorted((x[0], x[2], sorted((sets[a] if x[3:5] == jaccard.set_sums(sets[a]) else sets[b]).tolist())) for x in nodes)
        if all(x[-1] == 1 for x in nodes):
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_labels_by_queries_and_on_the_driver(spark, monkeypatch):
    r = random.Random(5)
    chain = [(k, k + 1) for k in range(-40, 60)]
    r.shuffle(chain)
    parts = [chain[:50], [], [(500, 500)], chain[50:] + [(200, 300), (300, 100)], [(r.randrange(400, 480), r.randrange(400, 480)) for _ in range(60)]]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in sum(parts, []):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    asked = spark.range(-50, 600).withColumnRenamed("id", "doc")
    for held in (70, 10**6):
        monkeypatch.setattr(components, "HELD_LINKS", held, raising=False)
        labels = Labels()
        for part in parts:
            labels.take(materialize(spark.createDataFrame(part, "a long, b long"), "test"))
        assert {x.doc: x.comp for x in labels.of(asked, "doc", "comp").collect()} == {x: find(x) for x in range(-50, 600)}
        assert (labels.held is None) == (held < 10**6)


def test_jaccard_makes_few_tables(spark, monkeypatch):
    """Every table is a query or more, whose plans and threads stay in the driver's memory for a while."""
    made = []
    for module in (components, jaccard):
        monkeypatch.setattr(module, "materialize", lambda df, name: made.append(name) or materialize(df, name))
    monkeypatch.setattr(jaccard, "PAIRED", 4)
    df = materialize(spark.createDataFrame(list(enumerate(family())), "doc_id long, text string"), "test")
    jaccard.link_documents(df, frequent=6).count()
    assert len(made) <= 45, made  # 58 with rounds of queries for every few links


def orphans(n=40):
    """Copies of one size whose original is missing, each with two edits of its own: heads lack what the others share."""
    out = []
    for k in range(n):
        r, ws = random.Random(900 + k), [f"w{i}" for i in range(103)]
        for i in r.sample(range(25), 2):
            ws[4 * i + r.randrange(2)] = f"own{k}x{i}"
        out.append(" ".join(ws))
    return out


def test_jaccard_of_copies_without_their_original(spark, monkeypatch):
    made = []
    for module in (components, jaccard):
        monkeypatch.setattr(module, "materialize", lambda df, name: made.append(name) or materialize(df, name))
    monkeypatch.setattr(jaccard, "PAIRED", 4)
    rows = [(i, t, None, None, 0) for i, t in enumerate(orphans())]
    df = materialize(spark.createDataFrame(rows, DOCS), "test")
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard.link_documents(df, frequent=6).collect()}
    assert got == brute_components(rows)
    assert made.count("mixed") <= 4  # a level for nearly every copy before


def test_jaccard_compares_a_group_in_one_task(spark, monkeypatch):
    """Small groups are compared whole from the second level on, larger ones divided, some of both; the result is the same."""
    monkeypatch.setattr(jaccard, "PAIRED", 4)
    rows = [(i, t, None, None, 0) for i, t in enumerate(family(60))]
    df, want = materialize(spark.createDataFrame(rows, DOCS), "test"), brute_components(rows)
    for together in (0, 12):
        monkeypatch.setattr(jaccard, "TOGETHER", together, raising=False)
        assert {r.doc: (r.n_shingles, r.component) for r in jaccard.link_documents(df, frequent=6).collect()} == want
    tokens = [list(x) for x in (range(20), range(1, 21), range(2, 22), range(50, 70), [50], range(5, 21))]
    group = pa.table({"doc": pa.array(range(6)), "comp": pa.array([0, 1, 2, 3, 4, 2]), "tokens": pa.array(tokens, pa.list_(pa.int64()))})
    assert jaccard._together(85)(group).to_pylist() == [{"a": 0, "b": 1}, {"a": 1, "b": 2}]


def test_jaccard_sends_small_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: seen.append(int(spark.conf.get(key))) or materialize(df, name))
    before = spark.conf.get(key)
    jaccard.link_documents(spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")).count()
    assert seen and max(seen) <= 1000 and spark.conf.get(key) == before


def test_jaccard_of_ids_with_several_texts(spark):
    a, b, c = (" ".join(words(60, k)) for k in (21, 22, 23))
    rows = [(5, a + " x"), (5, b + " y"), (5, b + " y"), (1, a), (2, b), (9, c), (9, c), (7, c + " z"), (8, "")]
    got = {(r.doc, r.component) for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 1), (1, 1), (2, 1), (9, 7), (7, 7), (8, 8)}


def test_jaccard_keeps_the_first(spark):
    a, b = " ".join(words(40, 1)), " ".join(words(40, 2))
    df = spark.createDataFrame([(3, a), (1, a.upper()), (2, b), (4, None), (5, ""), (None, a)], "doc_id long, text string")
    assert sorted((r.doc_id for r in jaccard.keep_first(df).collect()), key=str) == [1, 2, 4, 5, None]
    assert jaccard.link_documents(df.limit(0)).count() == 0


def test_pair_keys_meet_for_linked_documents():
    """Sketches and levels: linked sets share a pair of tokens within a group at a common level."""
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(300):
        n = int(r.integers(2, 400))
        a = np.unique(r.integers(-(2**63), 2**63 - 1, n))
        b = a.copy()
        for _ in range(int(r.integers(0, max(1, n // 8)))):
            b[r.integers(0, len(b))] = r.integers(-(2**63), 2**63 - 1)
        b = np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both) or len(a) < 2 or len(b) < 2:
            continue

        def keys(x):
            sketch = x[: jaccard.sketch_size(x, 85)]
            found = set()
            for bits in jaccard.levels(len(x), 85):
                g = jaccard.group_of(sketch, bits)
                found |= {(bits, int(sketch[i]), int(sketch[j])) for i in range(len(sketch)) for j in range(i + 1, len(sketch)) if g[i] == g[j]}
            return found

        assert keys(a) & keys(b)


def test_decontamination_against_brute_force(spark, docs):
    rows = corpus()
    own = [(1, " ".join(words(70, 2))), (2, " ".join(words(300, 1)[40:70])), (3, "nobody has these words at all here"), (4, None), (5, "one two three"), (6, ""), (7, " ".join(words(70, 2)).upper())]
    items = spark.createDataFrame(own, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.find_items(docs, items).collect()}
    want = {i: decontam.word_shingles(t, 5) for i, t in own if t}
    for i, text, *_ in rows:
        has = decontam.word_shingles(text or "", 5)
        hit = sorted(k for k, s in want.items() if s and len(s & has) >= 0.8 * len(s))
        assert got[i].item_ids == hit and got[i].contaminated == bool(hit)
    assert decontam.find_items(docs, items.limit(0)).where("contaminated").count() == 0
    # many blocks of items, so that what is found is written on the way
    many = {r.doc_id: r for r in decontam.find_items(docs, items, block_bytes=80).collect()}
    assert many == got


def test_decontamination_of_scattered_parts_clashes_and_blanks(spark):
    item, far = words(60, 31, 10**6), words(4000, 32, 10**6)
    rows = [(0, None, "x"), (1, "", "x"), (2, "one two three four", "x"), (2, "one two three four", "x")]
    for parts in (1, 2, 3):
        size = len(item) // parts
        text = []
        for k in range(parts):
            text += far[1000 * k : 1000 * k + 1000] + item[size * k : size * (k + 1)]
        rows.append((10 + parts, " ".join(text), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, Item_IDs string")
    got = decontam.find_items(docs, spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "One two three four")], "item_id long, text string"))
    assert sorted(got.columns) == sorted(["doc_id", "text", *decontam.RESULTS])
    found = sorted((r.doc_id, r.item_ids) for r in got.collect())
    assert found == [(0, []), (1, []), (2, [3]), (2, [3]), (11, [1]), (12, [1]), (13, [1])]
    assert decontam.find_items(docs.limit(0), docs.limit(0).withColumnRenamed("doc_id", "item_id")).count() == 0


def test_mixing(spark, docs):
    first = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    again = {r.doc_id: r for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert first == again
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in corpus()}
    source = {i: s for i, _, _, s, _ in corpus()}
    order = sorted({s for s in source.values() if s}) + [None]
    total = {s: sum(sizes[i] for i in sizes if source[i] == s) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, list(order)
    left = 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if level * weight[s] > 2 * total[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    for i, r in first.items():
        assert (r.size, r.source_size) == (sizes[i], total[source[i]]) and r.target == pytest.approx(target[source[i]])
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
    for s in order:
        share = target[s] / total[s]
        mine = [r for i, r in first.items() if source[i] == s]
        assert abs(sum(r.copies for r in mine) - share * len(mine)) <= 1
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_hash_of_kept_words(spark):
    text = " ".join(words(60, 8))
    df = spark.createDataFrame([(1, text), (2, "a  b\n" + text)], "doc_id long, text string")
    got = {r.doc_id: r.h for r in substrings.deduplicate_substrings(df).select("doc_id", F.sha2("kept_text", 256).alias("h")).collect()}
    assert got == {1: hashlib.sha256(text.encode()).hexdigest(), 2: hashlib.sha256(b"a b").hexdigest()}
