"""Operators on the whole corpus against plain versions: near duplicates, line runs, the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import bpe, decontaminate, language_id, line_dedup, near_dedup, textvec
from webloom.llm.components import components


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def roots(nodes, links):
    parent = {n: n for n in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def test_components_of_chains_hubs_and_cycles(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (300, 300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(70)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links + links[:5] + [(None, 3)], "a bigint, b bigint")).collect()}
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert got == roots(ends, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text, width):
    words = re.findall(r"[^\x20\t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def brute_classes(rows, percent, width):
    sets = {d: shingles(t, width) for d, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, roots(ids, links)


def near_copies(seed):
    """Texts in groups: exact copies, copies with few or many edits, chains of edits, texts that share a passage."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocab, k=60)
    texts = []
    for _ in range(8):
        base = rng.choices(vocab, k=rng.choice([4, 12, 60, 150]))
        texts += [base] * 3
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 15))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(copy)
        chain = list(base)
        for _ in range(6):
            chain = list(chain)
            chain[rng.randrange(len(chain))] = rng.choice(vocab)
            texts.append(chain)
    texts += [rng.choices(vocab, k=50) + passage for _ in range(25)]
    rng.shuffle(texts)
    rows = [(k * 7 % 1009, " ".join(t) if k % 3 else "\n".join(t).title()) for k, t in enumerate(texts)]
    return rows + [(5000, None), (5001, ""), (5002, "one"), (5003, "One"), (5004, "one two"), (5005, " \t")]


def test_near_duplicates_equal_brute_force(spark):
    for percent, width, seed in ((85, 3, 1), (80, 5, 2)):
        rows = near_copies(seed)
        got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent, width).collect()}
        sets, want = brute_classes(rows, percent, width)
        assert {d: r["component_id"] for d, r in got.items()} == want
        assert all(r["n_shingles"] == len(sets[d]) and r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_words_of_one_weak_hash_are_not_linked_and_leak_nothing(spark):
    """Two words that polynomial hashes modulo 2^64 cannot tell apart."""
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{x} b c"), (2, f"{y} b c"), (3, f"{x} b c")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 85, 3).collect()} == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([(7, f"{x} b")], "item_id bigint, text string")
    assert sorted(r["doc_id"] for r in decontaminate.leaks(docs, items).collect()) == [1, 3]


def test_near_duplicates_odd_rows(spark, odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == 10
    assert {r["component_id"] for r in got if r["doc_id"] == 6} == {5}
    assert all(r["component_id"] == r["doc_id"] for r in got if r["doc_id"] in (1, 2, 3, 4, 7))
    assert near_dedup.near_duplicates(empty).count() == 0


def test_bands_meet_at_the_threshold():
    """Random pairs of sets at similarity 0.85 and 0.8, of few and of many shingles, share a bucket."""
    rng = np.random.default_rng(21)
    for union in (7, 20, 100, 400, 2000):
        for percent, least in ((85, 0.999), (80, 0.995)):
            met, pairs = 0, 400
            for _ in range(pairs):
                values = rng.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2)
                common = -(-percent * union // 100)
                split = common + int(rng.integers(0, union - common + 1))
                sets = [np.sort(np.concatenate([values[:common], own])) for own in (values[common:split], values[split:])]
                rows = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
                keys = near_dedup.bands(near_dedup.densified(np.concatenate(sets), rows))
                met += bool((keys[0] == keys[1]).any())
            assert met / pairs >= least, (union, percent)


def test_prefixes_of_linked_sets_meet():
    rng, often = np.random.default_rng(22), np.zeros(near_dedup.SLOTS, np.int64)
    often[rng.integers(0, near_dedup.SLOTS, 5000)] = 7
    for percent in (80, 85):
        for _ in range(800):
            union = int(rng.integers(1, 60))
            values = rng.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2)
            common = -(-percent * union // 100)
            split = common + int(rng.integers(0, union - common + 1))
            x, y = sorted((np.sort(np.concatenate([values[:common], own])) for own in (values[common:split], values[split:])), key=len)
            owner, token, place = near_dedup.prefixes(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), often, percent)
            first = {int(t): int(p) for o, t, p in zip(owner, token, place) if o == 0 and p <= len(x) + (-2 * percent * len(x)) // (100 + percent)}
            second = {int(t): int(p) for o, t, p in zip(owner, token, place) if o == 1}
            assert any(min(len(x) - first[t], len(y) - second[t]) * (100 + percent) >= percent * (len(x) + len(y)) for t in first.keys() & second.keys())


def test_a_bucket_of_many_unlinked_classes(spark):
    """20,000 texts share a long passage and are not linked, but for one pair that no star joins."""
    rng = random.Random(23)
    passage = " ".join(f"p{i}" for i in range(120))
    own = [" ".join(f"o{rng.randrange(10**9)}" for _ in range(14)) for _ in range(20_000)]
    rows = [(i, f"{passage} {x}") for i, x in enumerate(own)] + [(30_000, f"{passage} {own[7]} end"), (30_001, f"{passage} {own[9]} end")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), 85, 3).where("NOT kept").collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(30_000, 7), (30_001, 9)}


def brute_lines(rows, least=line_dedup.LEAST_WORDS):
    """Text of each row without later copies of passages, by the definition."""
    seen, cut = set(), {}
    for key, text in sorted(((r, t) for r, t in rows if t is not None), key=lambda x: x[0]):
        lines = text.split("\n")
        words = [x.count(" ") + 1 if x else 0 for x in lines]
        gone = set()
        for i in range(len(lines)):
            j, n = i, 0
            while j < len(lines) and n < least:
                n += words[j]
                j += 1
            if n >= least:
                passage = tuple(lines[i:j])
                if passage in seen:
                    gone |= set(range(i, j))
                seen.add(passage)
        cut[key] = "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)
    return cut


def test_line_runs_equal_the_definition(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choices(["a", "bb", "ccc", "dd"], k=rng.randrange(1, 30))) for _ in range(12)] + ["", "x"]
    long = " ".join(["word"] * 55)
    rows = []
    for d in range(80):
        lines = [rng.choice(pool) if rng.random() < 0.7 else f"own {d} {rng.random()} " * rng.randrange(1, 9) for _ in range(rng.randrange(1, 25))]
        if d % 4 == 0:
            at = rng.randrange(len(lines))
            lines[at:at] = pool[:6]
        if d % 9 == 0:
            lines.append(long)
        rows.append((d, "\n".join(lines)))
    rows += [(100, rows[0][1]), (101, "\n".join([long] * 4)), (102, ""), (103, "\n\n")]
    got = {r["doc_id"]: (r["text"], r["lines_deleted"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), whole_runs=False).collect()}
    want = brute_lines(rows)
    assert {d: t for d, (t, _) in got.items()} == {d: t for d, (t, _) in want.items()}
    assert {d: n for d, (_, n) in got.items()} == {d: n for d, (_, n) in want.items()}
    assert sum(n for _, n in want.values()) > 50


def brute_runs(rows, least=line_dedup.LEAST_WORDS):
    """Lines of each row that belong to a later copy of a repeated run of enough words, by trying every run."""
    seen, cut = set(), {}
    count = Counter(x for _, text in rows for x in (text or "").split("\n"))
    for key, text in sorted((r for r in rows if r[1] is not None)):
        lines = text.split("\n")
        words = [x.count(" ") + 1 if x else 0 for x in lines]
        gone = set()
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                if count[lines[j]] == 1:  # no run with this line is repeated
                    break
                n += words[j]
                if n >= least and tuple(lines[i : j + 1]) in seen:
                    gone |= set(range(i, j + 1))
                if n >= least:
                    seen.add(tuple(lines[i : j + 1]))
        cut[key] = "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)
    return cut


def test_whole_runs_equal_brute_force(spark):
    rng = random.Random(15)
    pool = [" ".join(rng.choices(["a", "bb", "ccc", "dd"], k=n)) for n in (60, 20, 20, 10, 22, 93, 2, 1, 5, 30)] + [""]
    run = ["w " * 59 + "w", "x " * 19 + "x", "y " * 19 + "y"]
    rows = [(0, "\n".join(["own 0", *run, "end 0"])), (1, "\n".join(["own 1", *run, "end 1"])), (2, "\n".join([*run[:2], *[""] * 40, "z"])), (3, "\n".join([*run[:2], *[""] * 40, "z"]))]
    for d in range(4, 60):
        rows.append((d, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {d} {rng.random()}" for _ in range(rng.randrange(1, 20)))))
        if d % 3 == 0:
            rows[-1] = (d, rows[-1][1] + "\n" + "\n".join(pool[rng.randrange(5) :]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["lines_deleted"]) for r in line_dedup.dedup_lines(df).collect()}
    want = brute_runs(rows)
    assert got == want and got[1] == ("own 1\nend 1", 3)
    assert sum(n for _, n in want.values()) > sum(n for _, n in brute_lines(rows).values())


def test_line_query_equals_brute_force_and_its_sql(spark, data):
    import duckdb

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["text"], r["lines_deleted"]) for r in line_dedup.query(spark, data).collect()}
    want = brute_runs(rows)
    assert got == want and sum(n for _, n in want.values()) > 50
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
        assert {d: (t, n) for d, t, n in db.execute(line_dedup.ORACLE).fetchall()} == want


def test_line_runs_odd_rows(spark, odd, empty):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == 10 and all(r["lines_deleted"] == 0 for r in got)
    assert sorted(map(repr, (r["text"] for r in got))) == sorted(map(repr, (r["text"] for r in odd.collect())))
    assert line_dedup.dedup_lines(empty).count() == 0
    long = "word " * 60
    same = spark.createDataFrame([(1, long), (1, long), (2, long), (None, long)], "doc_id bigint, text string")
    # A null id comes first; rows with equal id and text are one document.
    assert sorted((r["doc_id"] or 0, r["lines_deleted"]) for r in line_dedup.dedup_lines(same).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1)]


def test_line_dedup_plan_has_no_python(spark, odd):
    plan = line_dedup.dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_pipeline_equals_brute_force_stages(spark, data):
    import public_tokenizers

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.cache()
        kept = stage(spark, before, data).cache()
        assert kept.columns == docs.columns
        rows, left = {r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in kept.collect()}
        if name == "language_id":
            letters = {d for d, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}
            assert set(left) == letters
            assert all(left[d] == rows[d] for d in left)
        elif name == "line_dedup":
            want = brute_runs([(d, r["text"]) for d, r in rows.items()])
            assert {d: r["text"] for d, r in left.items()} == {d: t for d, (t, n) in want.items() if not n or t.strip()}
            assert all(r["n_chars"] == len(r["text"]) for d, r in left.items() if want[d][1])
        elif name == "near_dedup":
            _, classes = brute_classes([(d, r["text"]) for d, r in rows.items()], 80, 5)
            assert set(left) == {d for d, c in classes.items() if d == c}
        else:
            items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
            model = decontaminate.Items([r["item_id"] for r in items], [r["text"] for r in items])
            # By brute force: a row stays unless some stretch of it is within the distance of an item.  Shared words tell which
            # pairs need the table of distances; all others are further apart.
            for d, r in rows.items():
                words = textvec.Words(*textvec.utf8(pa.array([r["text"]])), space=textvec.NOT_ALNUM, ideographs=True).hashes
                near = [k for k, w in enumerate(model.words) if np.isin(w, words).sum() >= len(w) - decontaminate.most_edits(len(w))]
                leak = any(decontaminate.least_distance(model.words[k], words)[0] <= decontaminate.most_edits(len(model.words[k])) for k in near)
                assert (d not in left) == leak, d
            spaced = lambda t: f" {' '.join(re.findall(r'[a-z0-9\u0080-\U0010ffff]+', re.sub('[A-Z]', lambda m: m[0].lower(), t)))} "
            exact = {d for d, r in rows.items() if any(spaced(x["text"]) in spaced(r["text"]) for x in items)}
            assert exact.isdisjoint(left) and len(left) >= len(rows) - len(exact) - 0.02 * len(rows) and model.ids
    final = corpus_pipeline.STAGES[-1][1](spark, kept, data).collect()
    assert sorted(r["doc_id"] for r in final) == sorted(left)
    model = bpe.transducer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert all(model.decode(__import__("numpy").array(r["ids"])) == texts[r["doc_id"]] for r in final)


def test_language_stage_drops_foreign_texts_and_keeps_the_rest(spark, data):
    rng = random.Random(17)
    foreign = [
        "Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset ja joka on maan virallinen kieli",
        "Türkçe güneydoğu Avrupa ve batı Asyada konuşulan, Türk dilleri dil ailesine ait sondan eklemeli bir dildir ve milyonlarca kişi konuşur",
        "Język polski należy do grupy zachodniosłowiańskiej i jest językiem urzędowym w Polsce oraz jednym z języków urzędowych Unii Europejskiej",
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(400)),
    ]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    added = docs.limit(1).crossJoin(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(foreign)], "i bigint, t string"))
    more = added.select(*[F.col({"doc_id": "i", "text": "t"}.get(c, c)).alias(c) if c != "lang" else F.lit(None).cast("string").alias(c) for c in docs.columns])
    short = more.where("doc_id = -1").withColumn("doc_id", F.lit(-9).cast("bigint")).withColumn("text", F.lit("A.\nAll rights reserved." + " 12345" * 900))
    left = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(more).unionByName(short), data).collect()}
    letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert left == letters | {-9}


def test_language_limit_is_loose_with_little_labelled_text():
    assert language_id.Model({"en": ["plain words"], "fr": ["des mots " * 900]}).foreign == language_id.LOOSE
    assert language_id.Model({"en": ["plain words " * 600], "fr": ["des mots " * 900]}).foreign == language_id.FOREIGN


def test_stages_take_odd_and_empty_rows(spark, odd, empty, data):
    """Each stage on nulls, blanks, repeats, clashing columns: exactly these rows stay, in the columns that came."""
    ids = lambda df: sorted(((r["doc_id"] or 0, r["text"]) for r in df.collect()), key=repr)
    rows = ids(odd)
    letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    stages = dict(corpus_pipeline.STAGES)
    # All labelled rows are one language's, a short sample: everything with letters it has seen stays.
    left = ids(stages["language_id"](spark, odd, data))
    assert set(left) <= set(letters) and {r for r in letters if (r[1] or "").isascii()} <= set(left)
    # One line of 30,000 words occurs once; shorter lines are no run.
    assert ids(stages["line_dedup"](spark, odd, data)) == rows
    # Rows of id 5 with one text are one row, id 6 is a copy of it; rows without a set or an id pass.
    assert ids(stages["near_dedup"](spark, odd, data)) == sorted({r for r in rows if r[0] != 6}, key=repr)
    assert ids(stages["decontamination"](spark, odd, data)) == rows
    assert stages["bpe_encoding"](spark, odd, data).count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, data)
        assert out.count() == 0 and (name == "bpe_encoding" or out.columns == empty.columns)


def test_training_without_labels(spark, odd):
    assert language_id.train(odd.withColumn("lang", F.lit(None).cast("string"))).languages == []
