"""Training-data operators against brute force, the libraries, and awkward tables."""

import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import _common, _tokenizers, chat_format, fingerprints, line_dedup, mixing, packing, quality_classifier, quality_rules, queries, simhash_dedup, suffix_dedup, token_counts

DATA = "/root/testdata/sf0.001"
AWKWARD = [
    (1, "one two three four five six seven eight\n\nshort", "s1"), (2, None, None), (3, "", "s1"), (None, "no id here at all " * 9, "s2"), (1, "one two three four five six seven eight\n\nshort", "s1"),
    (5, "Ünïcode wörds <|im_end|> " * 40, "s2"), (6, "x" * 300_000, "s3"), (7, " \t\n ", "s1"), (None, None, None), (8, "one two three four five six seven eight\n\nshort", "s1"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    clash = ["__own", "__kept", "__times", "__plan", "__s", "__copy", "label", "row", "t", "id", "digest", "hash", "left_id", "times"]
    rows = [(i, t, s, "en", 0, True, 1, "x", *range(len(clash))) for i, t, s in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, kept boolean, size int, fp string, " + ", ".join(f"{c} int" for c in clash))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def variants(seed=5, n=120):
    random.seed(seed)
    words = ["alpha", "beta", "gamma", "délta", "x", "yy", "zzz", "omega", "Kappa", "rho"]
    said = lambda k: " ".join(random.choice(words) + str(random.randint(0, 40)) for _ in range(k))
    base = [said(80) for _ in range(8)]
    out = []
    for i in range(n):
        t = random.choice(base).split()
        for _ in range(random.randint(0, 4)):
            t[random.randrange(len(t))] = said(1)
        out.append((i, " ".join(t) if i % 3 else said(random.randint(0, 30))))
    return out


def slow_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 3}])
def test_simhash_groups(spark, options):
    rows = [*variants(), (900, None), (901, ""), (None, "lone text"), (902, "lone text")]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_dedup.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    prints = [slow_simhash(t) for _, t in rows]
    group = components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = defaultdict(list)
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g].append(i)
    assert got == {(i, f"{p:016x}"): min(least[g]) for (i, _), p, g in zip(rows, prints, group, strict=True)}


def test_one_row_of_each_group_stays(spark):
    random.seed(21)
    said = ["".join(random.choice("abcdefgh") + random.choice(("", "", " ")) for _ in range(400)) for _ in range(5)]
    rows = [(None, said[0]), (None, said[1]), (None, said[2]), (None, said[2]), (1, said[3]), (1, said[4]), (2, said[3]), (3, said[4]), (None, said[4])]
    got = simhash_dedup.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted({(None, said[0]), (None, said[1]), (None, said[2]), (1, said[3]), (1, said[4])}, key=str)


def word_likeness(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]), len(sets[0] | sets[1])


@pytest.mark.parametrize("options", [{}, {"set_texts": 4}])
def test_near_copies_by_jaccard(spark, options):
    random.seed(31)
    said = lambda n: [f"w{random.randint(0, 3000)}" for _ in range(n)]
    rows = [(900, None), (901, ""), (902, "lone Text"), (903, "lone text"), (904, "one two three four five"), (905, "one two three four six")]
    for i in range(40):
        base = said(150)
        for j in range(4):
            for _ in range(random.randint(0, 2)):
                base[random.randrange(150)] = said(1)[0]
            rows.append((10 * i + j, " ".join(base)))
    prints = [slow_simhash(t) for _, t in rows]

    def linked(i, j):
        both, either = word_likeness(rows[i][1] or "", rows[j][1] or "")
        return (prints[i] ^ prints[j]).bit_count() <= 4 or 10 * both >= 8 * either

    group, least = components(len(rows), linked), {}
    for (i, t), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, (i, t)), (i, t), key=lambda x: x[0])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, simhash_dedup.keep_one_per_group(table, jaccard_words=5, **options).collect()))
    assert got == sorted(least.values())
    assert len(got) < simhash_dedup.keep_one_per_group(table).count()
    assert sorted(map(tuple, corpus_pipeline.near_copy_stage(spark, table, DATA).collect())) == got


def slow_cut(rows):
    first, out = {}, []
    order = lambda i: i if i is not None else suffix_dedup.NO_ID
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(order(i), first.get(b[p : p + 50], suffix_dedup.NO_ID))
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < order(i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"hot": 3, "pack_bytes": 3000}])
def test_repeated_bytes(spark, options):
    rows = [*variants(7, 90), (91, "ab" * 90), (92, "b" + "ab" * 70), (None, "ab" * 90), (93, None), (91, "ab" * 90)]
    got = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_cut(rows)


def test_blind_trie_sorts():
    random.seed(2)
    strings = sorted({bytes(random.choice(b"ab") for _ in range(random.randint(0, 9))) for _ in range(80)}, key=lambda s: (len(s), random.random()))
    order = list(suffix_dedup.BlindTrie(strings).ordered())
    assert [strings[i] for i, _ in order] == sorted(strings)
    for (i, _), (j, shared) in zip(order, order[1:], strict=False):
        a, b = strings[i], strings[j]
        assert shared == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_deep_shallow_sort(monkeypatch):
    random.seed(6)
    common = b"the same twenty bytes at least, "
    strings = list({common + bytes(random.choice(b"abc") for _ in range(random.randint(0, 40))) for _ in range(300)})
    tail = common + b"a" * 30
    strings = list(dict.fromkeys([*strings, tail + b"x", tail + b"y", tail + b"yz", common]))
    tries = []
    real = suffix_dedup.BlindTrie.__init__
    monkeypatch.setattr(suffix_dedup.BlindTrie, "__init__", lambda self, own: tries.append(own) or real(self, own))
    order = list(suffix_dedup.deep_shallow(strings))
    assert [strings[i] for i, _ in order] == sorted(strings)
    for (i, _), (j, shared) in zip(order, order[1:], strict=False):
        assert shared == suffix_dedup.shared_bytes(strings[i], strings[j])
    shallow = len(common) + suffix_dedup.SHALLOW_BYTES
    runs = defaultdict(set)
    for x in strings:
        runs[x[:shallow]].add(x)
    assert sorted(map(sorted, tries)) == sorted(sorted(r) for r in runs.values() if len(r) > 1)  # insertions for runs that still agree only


@pytest.mark.parametrize("name", ["op3_quality_rules", "op5_chat_format", "op7_mixing"])
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    plain = lambda f: sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in f[sorted(f.columns)].itertuples(index=False, name=None))
    assert plain(got) == plain(want)


def test_rule_order_changes_nothing(documents):
    facts = [quality_rules.Facts(t or "") for _, t in texts(documents)]
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        verdicts = [not quality_rules.base_fails(d) and not any(r.rejects([d])[0] for r in rules) for d in facts]
        assert sorted(r.doc_id for r in quality_rules.quality_rules(documents, rules=rules).where("kept").collect()) == sorted(i for (i, _), v in zip(texts(documents), verdicts, strict=True) if v)


def test_cascade_counts_only_what_is_left(documents, monkeypatch):
    seen = []
    counted = quality_rules.repeat_words
    monkeypatch.setattr(quality_rules, "repeat_words", lambda docs: seen.append(len(docs)) or counted(docs))
    docs = [quality_rules.Facts(t) for t in ("few words", "### &&& " * 20, "plain words of no kind " + " ".join(f"w{i}" for i in range(30)))]
    few, repeats = quality_rules.BASE
    assert quality_rules.cascade(docs, (few, quality_rules.RULES[2], repeats)).tolist() == [False, False, True] and seen == [1]
    kept = {r.doc_id for r in quality_rules.keep_by_rules(documents).collect()}
    monkeypatch.undo()
    assert kept == {r.doc_id for r in quality_rules.quality_rules(documents).where("kept").collect()}


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(5)
    d = quality_classifier.N_FEATURES
    x = {0: rng.normal(0, 1, (400, d)) * np.linspace(1, 3, d), 1: rng.normal(0.4, 1.5, (300, d))}
    sums = {k: (float(len(v)), v.sum(axis=0), v.T @ v) for k, v in x.items()}
    every = np.vstack([x[0], x[1]])
    centre, scale = every.mean(axis=0), every.std(axis=0)
    z = {k: (v - centre) / scale for k, v in x.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in z.items()}
    pooled = (400 * cov[0] + 300 * cov[1]) / 700
    test, logs = rng.normal(0, 2, (50, d)), []
    for k in (0, 1):
        pull = quality_classifier.TO_POOLED + d / (len(x[k]) + d)
        c = (1 - pull) * cov[k] + pull * pooled
        c = (1 - quality_classifier.TO_IDENTITY) * c + quality_classifier.TO_IDENTITY * np.trace(c) / d * np.eye(d)
        away = (test - centre) / scale - z[k].mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away) + np.linalg.slogdet(c)[1]))
    model = quality_classifier.fit(sums)
    assert np.allclose(model.log_odds(test), logs[1] - logs[0] + np.log(301 / 401))
    assert ((model.score(test) >= 0.5) == (model.log_odds(test) >= 0)).all()


def test_query_counts_are_the_librarys(spark, documents):
    counter = _tokenizers.ByteLevelCounter(_tokenizers.tokenizer_path(token_counts.VOCABULARY))
    want = []
    for i, t in texts(documents):
        n = len(counter.library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted(map(tuple, queries.op6_token_counts(spark, DATA).collect())) == sorted(want)


def test_query_of_fingerprints(spark, documents):
    got = {r.doc_id: r for r in queries.op9_document_fingerprints(spark, DATA).collect()}
    order = sorted(texts(documents), key=lambda r: r[0], reverse=True)
    prints = [slow_fingerprint(t) for _, t in order]
    for at, (i, t) in enumerate(order):
        t, follow, r = t or "", order[(at + 1) % len(order)][1] or "", got[i]
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        own, other = slow_fingerprint(edited), prints[(at + 1) % len(order)]
        assert (r.fingerprint, r.edited_fingerprint) == (f"{prints[at]:016x}", f"{own:016x}")
        assert (r.near_edited, r.near_next) == (1 - (prints[at] ^ own).bit_count() / 64, 1 - (prints[at] ^ other).bit_count() / 64)
        assert r.n_within == (sum((prints[at] ^ p).bit_count() <= 3 for p in prints) if i % 20 == 0 else None)


def test_quality_scores(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_classifier.quality_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    rows = got.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_classifier.quality_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), flipped)
    assert {r.doc_id: r.predicted for r in got.collect()} == {r.doc_id: r.predicted for r in again.collect()}  # held-out labels are not read


def test_chat_parts(spark):
    for text in ("<|im_end|>", "<\\|", "<\\\\|x<|", "<", "a<\\<|b"):
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert "<|" not in chat_format.escape(text)
    assert chat_format.unescape_role(chat_format.escape_role("a\n<|nl|>")) == "a\n<|nl|>"
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "r1", 28, 15, None, None), ("audio", None, "r2", None, None, 2.0, None), ("odd", None, "r3", None, None, None, None)]
    rows = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, None, None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    a, b = chat_format.format_turns(rows).orderBy("turn").collect()
    assert a.formatted == "<|im_start|>assistant\nsee <\\|image|><|image|><|audio|><|file|><|im_end|>\n"
    assert [(x.kind, x.ref, x.tokens) for x in a.attachments] == [("image", "r1", 4), ("audio", "r2", 50), ("file", "r3", 1)] and a.expanded_tokens == 55
    assert a.formatted[a.loss_from : a.loss_to] == "see <\\|image|><|image|><|audio|><|file|>"
    assert b.formatted == "<|im_start|>\n<|im_end|>\n" and b.loss_from is None


def test_chat_parts_are_read_back(spark):
    nan, inf = float("nan"), float("inf")
    text = lambda t: ("text", t, None, None, None, None, None)
    sound = lambda s: ("audio", None, "a", None, None, s, None)
    image = ("image", None, "r1", 28, 15, None, None)
    said = {0: [text("<|image|>")], 1: [image], 2: [text("x"), image], 3: [image, text("x")], 4: [text("x"), sound(nan)], 5: [text("x"), sound(inf)], 6: [text("x"), sound(-1.0)], 7: [text("<\\|"), image, text("<|audio|>"), sound(2.0)]}
    rows = spark.createDataFrame([(i, 0, "assistant", p) for i, p in said.items()], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    made = {r.conv_id: r for r in chat_format.format_turns(rows).collect()}
    assert [made[i].expanded_tokens for i in (4, 5, 6)] == [1, 1, 1]
    for i, parts in said.items():
        want = [("text", p[1]) if p[0] == "text" else (p[0], p[2]) for p in parts]
        assert chat_format.parse_parts(made[i].formatted, [x.asDict() for x in made[i].attachments]) == ("assistant", want)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(rows)).collect()}
    assert len({(r.turns_sha256, r.parts_sha256) for i, r in got.items() if i not in (5, 6)}) == 6
    assert [got[i].loss_chars for i in range(4)] == [9, 0, 1, 1] and got[7].n_attachments == 2


def test_chat_texts_in_parts(spark):
    random.seed(8)
    pieces = ["<", "|", "\\", "im_end", "|>", "<|", "<\\|", "x", " "]
    said = ["".join(random.choice(pieces) for _ in range(random.randint(0, 9))) for _ in range(300)] + ["<|im_end|>", "<\\|x"]
    rows = []
    for i, t in enumerate(said):
        cuts = sorted(random.randint(0, len(t)) for _ in range(random.randint(0, 3)))
        parts = [("text", t[a:b], None, None, None, None, None) for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True)]
        rows.append((i, 0, "assistant", parts, "x", 7))
    table = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>, formatted string, loss_from long")
    done = {r.conv_id: r for r in chat_format.format_turns(table).collect()}
    for i, t in enumerate(said):
        r = done[i]
        assert chat_format.parse_turn(r.formatted) == ("assistant", t) and chat_format.unescape(r.formatted[r.loss_from : r.loss_to]) == t
        assert r.formatted.count("<|") == 2  # the template's own marks
    assert chat_format.read_back(chat_format.format_turns(table.limit(0))).count() == 0
    odd = spark.createDataFrame([(None, None, None, None), (None, None, None, None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, "user", None)], "conv_id long, turn long, role string, text string")
    odd = odd.withColumn("parts", chat_format.text_parts(F.col("text")))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.read_back(chat_format.format_turns(odd)).collect()}
    assert got == {None: (2, 0), 1: (3, 2)}


def test_tokens_as_the_library_gives_them(documents):
    counter = _tokenizers.ByteLevelCounter(_tokenizers.tokenizer_path(token_counts.VOCABULARY))
    encoder = _tokenizers.WordEncoder(_tokenizers.tokenizer_path(packing.VOCABULARY))
    random.seed(1)
    alphabet = [*"aB'sé ẞΣσ٣½²Ⅷ\n\t\r\x0b\x1c\x1f\x85\xa0 　  , .!?_-中あ한😀é̀ſKİ12|<>", "<|endoftext|>", "<|startoftext|>", "  ", " the", " don't"]
    fuzz = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    for t in [*fuzz, *(t or "" for _, t in texts(documents))]:
        assert counter.count(t) == len(counter.whole(t))
        assert encoder.encode(t) == array("I", encoder.whole(t)).tobytes()


def test_token_cache(spark, documents, tmp_path):
    cache = str(tmp_path / "cache")
    first = sorted(map(tuple, token_counts.token_counts(documents, cache).collect()))
    stored = spark.read.parquet(cache).count()
    assert stored == documents.select("text").distinct().count()
    assert not any(r[4] for r in first)
    assert sorted(tuple(r) for r in token_counts.token_counts(documents, cache).collect()) == [(*r[:4], True) for r in first]
    assert spark.read.parquet(cache).count() == stored
    half = {(r.doc_id, r.cached): r.n_tokens for r in queries.op6_token_counts(spark, DATA).collect()}
    assert {c for _, c in half} == {True, False} and {i: n for (i, _), n in half.items()} == {r[0]: r[2] for r in first}


def test_mixture(spark, documents):
    rows = mixing.mix_sources(documents.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 50 == 1, "b"))).collect()
    total, by = sum(r["size"] for r in rows), defaultdict(list)
    for r in rows:
        by[r.source_size].append(r)
    assert abs(sum(g[0].target for g in by.values()) - total) < 1e-6 * total
    for g in by.values():
        assert abs(sum(r.taken for r in g) - g[0].target) <= max(r["size"] for r in g)
        assert all(r.taken <= 3 * r["size"] for r in g) and g[0].target <= 3 * g[0].source_size + 1e-6
    twice = documents.unionByName(documents.withColumn("source", F.lit("other")))
    want = sorted((r.doc_id, r["size"]) for r in mixing.mix_sources(twice).collect() for _ in range(r.copies))
    assert sorted((r.doc_id, len((r.text or "").encode().split())) for r in mixing.mixed(twice).collect()) == want
    mixed = mixing.mixed(documents)
    assert mixed.columns == documents.columns and mixed.count() == sum(r.copies for r in mixing.mix_sources(documents).collect())


def test_packing(documents):
    encoder = _tokenizers.WordEncoder(_tokenizers.tokenizer_path(packing.VOCABULARY))
    pieces = packing.pack_documents(documents, group_rows=64, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for i, t in texts(documents):
        raw = encoder.encode(t or "") + array("I", [1]).tobytes()
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == raw
        assert all(p.ids_crc32 == zlib.crc32(raw[4 * p.start : 4 * (p.start + p.length)]) and p.doc_tokens == len(raw) // 4 for p in own)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(p.length for p in pieces) / (2048 * len(by_sequence)) > 0.95


def test_first_fit_decreasing():
    random.seed(4)
    sizes = [random.randint(1, 2047) for _ in range(500)]
    bins, offsets = packing.first_fit_decreasing(sizes)
    room, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(2048)
        want[i], room[b] = b, room[b] - sizes[i]
    assert bins == want
    assert packing.first_fit_decreasing([]) == ([], [])


def slow_fingerprint(text):
    votes, total = [0] * 64, 0
    for w in (text or "").lower().encode().split():
        n = min(len(w), 15)
        weight, total = max(n * n >> 4, 1), total + max(n * n >> 4, 1)
        h = xxhash.xxh64_intdigest(w, 42)
        for b in range(64):
            votes[b] += weight * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def test_edit_report(spark, documents):
    rows = [*texts(documents)[:60], (None, "first without id"), (None, "second, without"), (77_000, None), (77_001, "")]
    got = fingerprints.edit_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()), reverse=True)
    want = []
    for at, (i, t) in enumerate(order):
        t, follow = t or "", order[(at + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        prints = [slow_fingerprint(x) for x in (t, edited, follow)]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *(p - (1 << 64) if p >> 63 else p for p in prints)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_find_within(spark):
    random.seed(9)
    base = [random.getrandbits(63) for _ in range(30)]
    fps = sorted({b ^ sum(1 << random.randrange(63) for _ in range(random.randint(0, 4))) for b in base for _ in range(6)})
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = fingerprints.find_within(table, table.where("fp % 2 = 0").select(F.col("fp").alias("query"))).collect()
    want = sorted((a, b, (a ^ b).bit_count()) for a in fps if a % 2 == 0 for b in fps if (a ^ b).bit_count() <= 3)
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("options", [{}, {"set_lines": 6, "pack_bytes": 2000}, {"set_lines": 2}])
def test_line_dedup(spark, options):
    random.seed(11)
    said = variants(3, 60)
    rows = [(i, "\n".join(t for _, t in random.sample(said, 3)) + "\n\n" + ("common line" if i % 2 else "Common lines")) for i in range(40)]
    rows += [(None, "Common lines\n" + said[0][1]), (7, None), (3, rows[3][1]), (50, rows[3][1]), (51, "\n \n")]
    order = lambda i: suffix_dedup.NO_ID if i is None else i
    places = [(order(i), at, x) for i, t in rows for at, x in enumerate((t or "").split("\n")) if x.strip()]
    lines = sorted({x for *_, x in places})
    n = line_dedup.SHINGLE
    sets = [{x.ljust(n, "\0")[k : k + n] for k in range(max(1, len(x) - n + 1))} for x in lines]
    group = dict(zip(lines, components(len(lines), lambda i, j: 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])), strict=True))
    first = {}
    for i, at, x in sorted(places):
        first.setdefault(group[x], (i, at))
    want = []
    for i, t in rows:
        said = (t or "").split("\n")
        kept = [x for at, x in enumerate(said) if not x.strip() or first[group[x]] == (order(i), at)]
        want.append((i, sum(1 for x in said if x.strip()), len(said) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_many_variants_of_one_line(spark):
    rows = [(i, f"Printed from the reading room catalogue, page {i} of the whole of the printed register") for i in range(300)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), set_lines=8).where("n_removed = 0").collect()
    assert [r.doc_id for r in got] == [0]
    linked = np.concatenate([nodes for _, nodes in line_dedup._dealt(np.uint64(5), np.arange(1000, dtype=np.uint64), line_dedup.mix64(np.arange(1000, dtype=np.uint64)), 8)])
    assert set(linked.tolist()) == set(range(1000)) and len(linked) < 1300  # each line in one chunk, and the chunks' first ones again


def test_bands_find_similar_lines():
    random.seed(12)
    pairs = []
    while len(pairs) < 1500:
        a = "".join(random.choice("abcdefgh ij") for _ in range(random.randint(30, 200)))
        b = list(a)
        for _ in range(random.randint(1, 4)):
            b[random.randrange(len(b))] = random.choice("xyz")
        b = "".join(b)
        sets = [{x[k : k + line_dedup.SHINGLE] for k in range(len(x) - line_dedup.SHINGLE + 1)} for x in (a, b)]
        if 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.9:
            pairs += [a, b]
    assert line_dedup.similar_pairs(pairs).all()
    keys = line_dedup.band_keys(pairs)
    assert (keys[::2] == keys[1::2]).any(axis=1).mean() > 0.99


def test_components_merge_forests(spark):
    random.seed(13)
    edges = [(random.randint(0, 900), random.randint(0, 900)) for _ in range(500)] + [(i, i + 1) for i in range(2000, 2100)] + [(5000, i) for i in range(5001, 5400)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    label = {x: x for x in nodes}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    table = spark.createDataFrame(edges, "u long, v long").repartition(8)
    for most in (1 << 21, 200):
        assert {r.node: r.label for r in _common.connected_components(table, most).collect()} == label


OPERATORS = {
    "simhash": simhash_dedup.simhash_groups, "bytes": suffix_dedup.remove_repeated_bytes, "rules": quality_rules.quality_rules, "mix": mixing.mix_sources,
    "pack": packing.pack_documents, "edits": fingerprints.edit_report, "lines": line_dedup.dedup_lines,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(awkward, name):
    rows = OPERATORS[name](awkward).collect()
    assert len(rows) >= len(AWKWARD) and {r.doc_id for r in rows} == {i for i, *_ in AWKWARD}
    assert OPERATORS[name](awkward.limit(0)).count() == 0


def test_awkward_scores_and_counts(spark, awkward, tmp_path):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (6, None), (5, 1)], "doc_id long, quality int")
    for table, known in ((awkward, labels), (awkward, labels.limit(0)), (awkward.limit(0), labels)):
        rows = quality_classifier.quality_scores(table, known).collect()
        assert len(rows) == table.count() and all(0 <= r.score <= 1 for r in rows)
    rows = token_counts.token_counts(awkward, str(tmp_path / "c")).collect()
    assert len(rows) == len(AWKWARD) and all((r.n_tokens == 0) == (r.n_bytes == 0) for r in rows)
    assert spark.read.parquet(str(tmp_path / "c")).count() == len({t or "" for _, t, _ in AWKWARD})
    assert token_counts.token_counts(awkward.limit(0), str(tmp_path / "d")).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_tables(spark, awkward, name, stage):
    docs = awkward.withColumn("n_chars", F.length("text").cast("long"))
    out = stage(spark, docs, DATA)
    assert name == "packing" or out.columns == docs.columns
    if name != "packing":
        assert {(r["__own"], r["__kept"], r["__times"], r.label, r.row, r.t, r.id, r.times) for r in out.collect()} <= {(0, 1, 2, 6, 7, 8, 9, 13)}
    assert out.count() >= (name != "quality rules")  # none of these texts has 20 words that differ
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_pipeline(spark, documents):
    kept = documents
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, DATA)
        kept = spark.createDataFrame(kept.collect(), documents.schema)
        assert kept.columns == documents.columns, name
    prints = [slow_simhash(r.text) for r in kept.collect()]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    assert corpus_pipeline.run(spark, DATA).count() > 0
