"""The corpus operators against brute force, and with nulls, empty tables and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tracklens.llm import fixity, images, mixing, phrases, pieces, pivots, rollups, sharding, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 int, _key string, size int, _id int, _size int, _cls int, _k1 int, _left int, _own int, __k2 int"


def documents(spark):
    """Words, repeats, copies, a shared passage, nulls and empty texts; columns that clash with ours."""
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ärger", "naïve", "日本", "A"]
    passage = " ".join(draw.choices(vocabulary, k=60))
    rows = []
    for i in range(60):
        own = " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 3, 30, 34, 35, 36, 80, 300])))
        if i % 5 == 0:
            own = f"{own} {passage}\t{own[:50]}"
        rows.append((i, own))
    rows += [(60 + i, rows[i][1]) for i in range(8)]
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "x " * 90), (None, "lonely"), (94, "a b " * 20), (5, rows[5][1])]
    return spark.createDataFrame([(i, t, "en", None if i and i % 7 == 0 else f"s{(i or 0) % 3}", len(t or ""), 1, "k", 2, 3, 4, 5, 6, 7, 8, 9) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def reach(ids, linked):
    """The least id of each item's component."""
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                label[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [least[root(i)] for i in range(len(ids))]


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    near = base[:12] + 0.05 * rng.standard_normal((12, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near, 2 * base[:3], base[:3]]))]
    odd = [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] * 16), (205, [float("inf")] * 16), (None, base[0].tolist()), (0, base[0].tolist())]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, copies string")
    got = pivots.near_duplicates(table).collect()
    sound = rows + [odd[-1]]
    unit = np.array([v for _, v in sound])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    wanted = sorted((i, int(close[k].sum()) - 1, c) for k, ((i, _), c) in enumerate(zip(sound, reach([i for i, _ in sound], lambda a, b: close[a, b]), strict=True)))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < 200) == wanted
    assert all(r.n_links == 0 and r.component_id == r.vec_id for r in got if r.vec_id is None or r.vec_id >= 200)
    assert pivots.near_duplicates(table.limit(0)).count() == 0


def slow_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    least = reach([i for i, _ in rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    wanted = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, least, strict=True)), key=repr)
    got = simhash.near_duplicates(docs)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=repr) == wanted
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {c for c in least if c is not None}


def test_fingerprint_links(spark):
    draw = random.Random(1)
    base = [draw.getrandbits(64) for _ in range(40)]
    some = sorted({b ^ sum(1 << k for k in draw.sample(range(64), n)) for b in base for n in range(7)})
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in some]
    for distance in (0, 1, 4, 6):
        got = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance).collect()
        pairs = [tuple(sorted((r.a, r.b))) for r in got]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {tuple(sorted((signed[i], signed[j]))) for i in range(len(some)) for j in range(i) if (some[i] ^ some[j]).bit_count() <= distance}


def test_substrings(docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    words = [WORD.findall(t or "") for _, t in rows]
    starts = {}
    for w in words:
        for i in range(len(w) - 34):
            starts[tuple(w[i : i + 35])] = starts.get(tuple(w[i : i + 35]), 0) + 1
    wanted = []
    for (name, _), w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - 34) if starts[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        wanted.append((name, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = phrases.remove_repeats(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)
    assert sum(r[2] for r in wanted) > 500
    clean = phrases.without_repeats(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert sorted(hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() for r in clean.collect()) == sorted(r[3] for r in wanted)
    assert phrases.remove_repeats(nothing).count() == 0


def test_mixing(docs, nothing):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    total = sum(r["size"] for r in got)
    targets = {r.source_size: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    longest = max(r["size"] for r in got)
    for source_size, target in targets.items():
        assert abs(sum(r.taken for r in got if r.source_size == source_size) - target) <= 2 * longest
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(nothing).count() == 0


def test_sharding(docs, nothing):
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count() and {r.law for r in got} == {"bytes"}
    for shard in {r.shard for r in got}:
        mine = sorted(r.slot for r in got if r.shard == shard)
        assert 0 <= shard < 8 and mine == list(range(len(mine)))
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    assert sharding.shard(nothing).count() == 0


def test_pieces(docs, nothing):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_decode(docs, model, keep=False).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        text = library.decode(ids)
        digests = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        assert (r.doc_id, len(ids), *digests) in got
    assert pieces.encode_decode(nothing, model).count() == 0


def test_fixity(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 4), "z") for i in range(300)] + [(5, "u", "twice", "z"), (None, None, None, "z"), (400, None, None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    first = fixity.records(pages)
    where = fixity.F.col("page_id").isin(17, 250)
    second = fixity.damaged(first, where).where("page_id IS NULL OR page_id != 33").unionByName(first.where("page_id = 40").selectExpr("9999L AS page_id", "url", "record"))
    found = fixity.audit(first, {"same": first.repartition(5), "bad": second}).collect()
    assert {(r.replica, r["at"], r.state) for r in found} == {("same", None, "sound"), ("bad", 17, "changed"), ("bad", 250, "changed"), ("bad", 33, "missing"), ("bad", 9999, "extra")}
    assert max(r.visited for r in found) < 330
    assert fixity.page_audit(pages.limit(0)).count() == 0


def test_rollups(spark, docs, nothing, tmp_path):
    import public_tokenizers
    import tiktoken  # noqa: F401

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = rollups.token_counts(docs, ranks, "v1").collect()
    got = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens, r.chars) for r in rollups.maintained(docs, ranks, "v1").collect()}
    wanted = {}
    for r in rows:
        a, b, c = wanted.get((r.source, r.lang, "v1"), (0, 0, 0))
        wanted[(r.source, r.lang, "v1")] = (a + 1, b + r.tokens, c + r.chars)
    assert got == wanted
    log = rollups.Rollup(spark, str(tmp_path / "log"))
    change = rollups.deltas(rollups.token_counts(nothing, ranks, "v1"), rollups.token_counts(docs, ranks, "v1"))
    assert log.commit("a", change) and not log.commit("a", change)
    assert sum(r.documents for r in log.totals().collect()) == docs.count()
    assert rollups.maintained(nothing, ranks, "v1").count() == 0


def test_images(spark):
    pages = spark.createDataFrame([(i, f"page {i} " * 20, "x") for i in range(12)] + [(12, "page 3 " * 20, "x"), (13, None, "x"), (14, "", "x")], "page_id long, html string, fp string")
    got = {r.id: r.component_id for r in images.copies(images.drawn(pages)).collect()}
    assert got[24] == got[6] == 6 and got[26] == 26
    found = sum(got[2 * i + 1] == 2 * i for i in range(12))
    strangers = sum(got[2 * i] != 2 * i for i in range(12))
    assert found >= 10 and strangers == 0
    assert images.copies(images.drawn(pages.limit(0))).count() == 0


def test_edited_images(spark):
    """Nine of ten crops, turned and smaller copies, of overdrawn crops 85 of 100, and no strangers; a large group stays together."""
    rows = [(i, f"picture {i}") for i in range(1200)]
    got = {r.id: r.component_id for r in images.copies(images.drawn(spark.createDataFrame(rows, "page_id long, html string"))).collect()}
    for kind in range(4):
        found = [got[2 * i + 1] == 2 * i for i in range(kind, 1200, 4)]
        assert sum(found) >= (0.85 if kind == 3 else 0.9) * len(found), kind
    assert all(got[2 * i] == 2 * i for i in range(1200))
    one, other, flat = images.render("one"), images.render("other"), np.full((64, 64), 9, np.uint8)
    odd = [(i, 64, one.tobytes(), "x") for i in range(40, 0, -1)] + [(500 + i, 56, one[4:60, 4:60].tobytes(), "x") for i in range(3)]
    odd += [(90, 64, other.tobytes(), "x"), (90, 64, other.tobytes(), "x"), (None, 64, one.tobytes(), "x"), (91, None, one.tobytes(), "x"), (92, 0, b"", "x"), (93, 7, one.tobytes(), "x"), (94, 64, None, "x"), (95, 2, b"abcd", "x"), (96, 64, flat.tobytes(), "x"), (97, 64, flat.tobytes(), "x")]
    found = images.copies(spark.createDataFrame(odd, "id long, width int, pixels binary, corners string")).collect()
    assert len(found) == len(odd)
    group = {r.id: r.component_id for r in found}
    assert {group[i] for i in [*range(1, 41), 500, 501, 502]} == {1}
    assert group[None] is None and all(group[i] == i for i in (90, 91, 92, 93, 94, 95, 96)) and group[97] == 96


def test_every_copy_of_a_bucket_is_compared(spark):
    """Pictures of one bucket are compared all with all, whatever their number and order; equal ones count as links."""
    whole = images.render("one")
    crops = [whole[y : y + 56, x : x + 56] for y in range(7) for x in range(7)]
    corners = images.described(np.stack(crops))
    a, b = np.triu_indices(len(crops), 1)
    linked = np.array([images.agreement(corners[i], corners[j]) >= images.AGREEING for i, j in zip(a, b, strict=True)])
    expected = np.bincount(np.concatenate([a[linked], b[linked]]), minlength=len(crops)).tolist()
    assert min(expected) > images.BUCKET  # more than a bucket's neighbours
    got = {r.id: (r.component_id, r.n_links) for r in images.copies(spark.createDataFrame([(i, 56, crop.tobytes()) for i, crop in enumerate(crops)], "id long, width int, pixels binary")).collect()}
    assert got == {i: (0, n) for i, n in enumerate(expected)}
    names = {7: 0, 8: 1, 9: 2, 10: 3}
    table = spark.createDataFrame([(p, corners[i].tobytes()) for p, i in names.items()], "p long, corners binary")
    buckets = spark.createDataFrame([(1, [9, 7, 10, 8]), (2, [10, 9, 8, 7]), (3, [7, 8])], "key long, ps array<long>")
    for bucket, side in ((32, 512), (2, 512), (2, 1), (2, 3)):
        assert sorted(map(tuple, images._linked(buckets, table, images.DISTANCE, images.AGREEING, bucket, side).collect())) == [(7, 8), (7, 9), (7, 10), (8, 9), (8, 10), (9, 10)], (bucket, side)


def test_strangers_that_share_one_shape(spark):
    """Matches that lie in one or two places are one shape at several scales and make no link."""
    corners = np.zeros(6, dtype=images.CORNER)
    corners["bits"] = np.random.default_rng(1).integers(0, 256, corners["bits"].shape)
    corners["y"], corners["x"] = np.array([80, 88, 80, 240, 248, 240]), np.array([80, 80, 88, 240, 240, 248])
    assert images.agreement(corners, corners) == 0
    corners["x"][5] = 400
    assert images.agreement(corners, corners) == 6


def test_toxicity(spark):
    draw = random.Random(5)
    words = ["the", "stone", "under", "water", "moves", "slowly", "because", "rivers", "bend", "again", "mountain", "letter"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        text = draw.choices(words, k=12) + ([draw.choice(["idiot", "moron"])] if toxic else [])
        draw.shuffle(text)
        rows.append((i, " ".join(f"{w}{draw.randrange(9)}" if w == "x" else w for w in text) + f" {draw.choice('abcdefgh') * 2}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}xyz"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    hidden = [(9001, "the 1d10t moves"), (9002, "the i d i o t moves"), (9003, "you m0r0n"), (9004, "idiooooot water"), (9005, "the stone moves slowly"), (9006, ""), (9007, None), (None, "m.o.r.o.n")]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(hidden, "doc_id long, text string"), model).collect()}
    assert got == {9001: 1, 9002: 1, 9003: 1, 9004: 1, 9005: 0, 9006: 0, 9007: 0, None: 1}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns
    assert docs.count() > 0


def test_pipeline_hands_over_few_documents_at_once(spark):
    """In a stage of the pipeline a Python worker is given few documents at a time, not thousands."""
    import corpus_pipeline

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(i, f"text {i} of some words") for i in range(3000)], "doc_id long, text string").coalesce(1)
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.substrings):
        try:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
            assert stage(spark, docs, "").count() == 3000
            rows = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
            assert max(r.n for r in rows.collect()) <= corpus_pipeline.BATCH_ROWS
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
