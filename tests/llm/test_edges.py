"""Odd inputs of every operator, and the forms that large inputs take."""

import random
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barspark.llm import common, mixing, near_dup, packing, quality, secret_scan, sharding, sketch, token_count, token_store, top_k

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, bits long, rep long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2, 3) for i, t in texts], DOCS)


def crc(text):
    ids = Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids
    return zlib.crc32(np.array([*ids, 1], "<u4").tobytes())


def prose(rnd, n):
    return " ".join(rnd.choice(("the", "of", "river", "Stone", "walks", "12", "over,", "mountain")) + rnd.choice(("", "s", "ing")) for _ in range(n))


def test_dictionary_is_fitted_on_long_texts(spark, tmp_path):
    rnd = random.Random(1)
    docs = spark.createDataFrame([(i, prose(rnd, 1500)) for i in range(400)], "doc_id long, text string")
    token_store.write_token_store(docs, str(tmp_path / "s"), WORD)
    blocks = spark.read.parquet(str(tmp_path / "s/blocks")).collect()
    sha, body = token_store._dictionary(spark, str(tmp_path / "s"))
    assert sha and len(body) > 1000 and {b["dict_sha256"] for b in blocks} == {sha}
    frame_ = bytes(blocks[0]["frames"])[: blocks[0]["offsets"][1]]
    with pytest.raises(token_store.zstandard.ZstdError):  # a frame needs the dictionary
        token_store.zstandard.ZstdDecompressor().decompress(frame_)
    got = {r["doc_id"]: r["ids_crc32"] for r in token_store.read_token_store(spark, str(tmp_path / "s")).collect()}
    assert all(got[r["doc_id"]] == crc(r["text"]) for r in docs.limit(20).collect())


def test_dictionary_of_equal_texts_and_tied_ids(spark, tmp_path):
    docs = frame(spark, [(7, "one and the same text " * 40)] * 300 + [(None, "no id " * 30)] * 50 + [(1, None)])
    token_store.write_token_store(docs, str(tmp_path / "s"), WORD)
    assert token_store._dictionary(spark, str(tmp_path / "s"))[0]
    got = token_store.read_token_store(spark, str(tmp_path / "s")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 50 + [1] + [7] * 300
    starts = np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1]
    assert [r["start"] for r in got] == starts.tolist()
    assert len(token_store.fetch_ids(spark, str(tmp_path / "s"), [7, 1])[7]) == 300


def test_very_long_texts(spark):
    rnd = random.Random(2)
    long = prose(rnd, 400_000)
    assert len(long) > 2_000_000
    docs = frame(spark, [(0, long), (1, long + " end"), (2, "short"), (3, long)])
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs).collect()}
    assert [got[i]["component_id"] for i in range(4)] == [0, 0, 2, 0]
    rows = {r["doc_id"]: r for r in quality.quality_ledger(docs).collect()}
    assert rows[0]["n_words"] == 400_000 and rows[0]["fail_bits"] & 1 << quality.RULE_NAMES.index("very_long")
    lib = Tokenizer.from_file(BYTE)
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in (long, "short")]
    counts = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(docs, BYTE).collect()}
    assert [counts[0], counts[2]] == want
    pieces = packing.pack_documents(docs, WORD).where("doc_id = 0").collect()
    assert sorted(p["piece"] for p in pieces) == list(range(len(pieces))) and len(pieces) > 100
    sized = {r["row"]["doc_id"]: r["size"] for r in sharding.shard_documents(docs, 2).collect()}
    assert sized[0] == len(long.encode()) + 1
    secret = f"{long} my password = hunter2hunter {long}"
    spans = secret_scan.scan(secret)[0]
    assert spans == [(len(long) + 4, len(long) + 4 + len("password = hunter2hunter"), "assign")]


def test_sharding_of_odd_rows(spark):
    rows = [(None, None), (None, ""), (1, "a"), (1, "a"), (2, None), (3, "é" * 50)] * 20
    got = sharding.shard_documents(frame(spark, rows), 8).collect()
    assert len(got) == 120 and {r["row"]["rep"] for r in got} == {3}
    assert Counter(r["size"] for r in got) == Counter({1: 60, 2: 40, 101: 20})
    assert {r["crc"] for r in got if r["size"] == 1} == {0}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_reports_how_many_groups_it_parts(spark):
    """Groups of equal texts stay whole unless one is over a hundredth of a shard from its place."""
    rows = [(i, "hot text of a third") for i in range(1000)] + [(1000 + i, f"text {i // 3} " * 5) for i in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    where = defaultdict(set)
    for r in got:
        where[r["row"]["text"]].add(r["shard"])
    assert sum(len(w) > 1 for w in where.values()) <= 8  # at most one at each boundary


def brute_top(rows, k, every):
    whole = {i: v for i, v in rows if v is not None}
    out = set()
    for q in (i for i in whole if i % every == 0):
        least, most = -(2**63) + 1, 2**63 - 1
        scores = sorted((-max(least, min(most, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("most", [top_k.MOST_BROADCAST_BYTES, 0], ids=["broadcast", "exchanged"])
def test_top_k_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(top_k, "MOST_BROADCAST_BYTES", most)
    monkeypatch.setattr(top_k, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(top_k, "SHARD_ROWS", 100)
    rnd = np.random.default_rng(8)
    rows = [(i, rnd.integers(-400, 400, 6).tolist()) for i in range(900)]
    table = spark.createDataFrame([(i, [x / 256 for x in v], 1, 2) for i, v in rows], "vec_id long, embedding array<double>, query_id int, kth int").repartition(4)
    got = top_k.top_k(table, k=4, every=45).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 4, 45) and len(got) == 80


@pytest.mark.parametrize("least_alone", [False, True])
def test_top_k_of_saturated_scores(spark, least_alone):
    big = 2.0**60
    values = {0: [big, big], 1: [-big, -big], 2: [big, big], 3: [1.0, 2.0], 50: [-big, big], 51: [3.0, -big]}
    if least_alone:  # the only large entries are the least integer, which has no absolute value
        values = {0: [-big, 1.0], 1: [1.0, 2.0], 2: [3.0, 1.0], 3: [-big, 2.0], 50: [2.0, 2.0]}
    table = spark.createDataFrame(list(values.items()), "vec_id long, embedding array<double>")
    rows = [(i, [max(-(2**63), min(2**63 - 1, int(256 * x))) for x in v]) for i, v in values.items()]
    assert {tuple(r) for r in top_k.top_k(table, k=5, every=50).collect()} == brute_top(rows, 5, 50)


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 1.0]), (1, [2.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [])]
    got = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 256 * 256), (0, 2, 1, 128 * 256)]


def test_stages_on_an_empty_table_and_odd_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long, `odd name, here` array<struct<`a b`: int>>")
    full = spark.createDataFrame([(1, prose(random.Random(3), 80) + " 7 birds", "s", 3, [(1,)])] * 2, empty.schema)
    for stage in (quality.keep_by_policy, secret_scan.redact_documents, mixing.emit_mix):
        assert stage(empty).count() == 0 and stage(empty).columns == empty.columns
        assert stage(full).schema["odd name, here"].dataType == empty.schema["odd name, here"].dataType
    assert secret_scan.redact_documents(full).count() == 2
    nothing = spark.createDataFrame([(1, None, None, None, None)], empty.schema)
    assert quality.keep_by_policy(nothing).count() == 0 and mixing.emit_mix(nothing).count() == 0
    assert [tuple(r) for r in secret_scan.redact_documents(nothing).collect()] == [(1, None, None, None, None)]


def test_policy_without_a_least_length(spark):
    rows = [(0, "A short good text."), (1, None), (2, " "), (3, "$ # % & $ # %"), (4, "one two one two one two one two")]
    kept = quality.keep_by_policy(spark.createDataFrame(rows, "doc_id long, text string"), "v2")
    assert {r["doc_id"] for r in kept.collect()} == {0}


def brute_targets(size, share=1.5, most=2):
    """Water level by raising it from stop to stop."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    full, left = set(), share * sum(size.values())
    while left and len(full) < len(size):
        level = (left - sum(most * size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in size if s not in full and level * weight[s] >= most * size[s]}
        if not more:
            return {s: most * size[s] if s in full else level * weight[s] for s in size}
        full |= more
    return {s: most * size[s] for s in size}


@pytest.mark.parametrize("most", [mixing.MOST_BROADCAST_SOURCES, 0], ids=["broadcast", "salted"])
def test_many_sources_and_a_hot_one(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_BROADCAST_SOURCES", most)
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randint(0, 40), "hot" if i % 3 == 0 else None if i % 50 == 1 else f"url{i % 997}") for i in range(3000)]
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), columns=["doc_id"]).collect()
    want = brute_targets(size)
    assert len(got) == 3000
    by_id = {r["row"]["doc_id"]: r for r in got}
    for i, t, s in rows:
        r = by_id[i]
        assert (r["size"], r["source_size"]) == (len(t.split()), size[s]) and r["target"] == pytest.approx(want[s], rel=1e-12)
        rate = want[s] / size[s] if size[s] else 0
        assert int(rate) <= r["copies"] <= int(rate) + 1


def slow_sketch(elements, t):
    """Every round of the scheme, one element and one bin at a time."""
    least = [None] * t
    for i in range(2 * t):
        for h in common.mix(elements, 0x5851F42D4C957F2D * (i + 1)).tolist():
            where = ((h >> 32) * t) >> 32 if i < t else i - t
            value = i << 32 | h & 0xFFFFFFFF
            if least[where] is None or value < least[where]:
                least[where] = value
        if None not in least:
            break
    return least


def test_sketch_against_the_slow_one():
    rnd = np.random.default_rng(4)
    for n in (*range(1, 12), 31, 63, 64, 65, 66, 100, 128, 129, 200):
        elements = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        assert sketch.sketch(elements, 64).tolist() == slow_sketch(elements, 64), n


def test_near_copies_of_few_shingles(spark):
    rnd, texts = random.Random(9), []
    for k in range(120):  # pairs of 4 to 30 shingles, alike by 0.75 or more, or a little less
        n = 4 + k % 27
        words = [f"k{k}w{i}" for i in range(n + 4)]
        texts += [" ".join(words), " ".join([*words, *(f"y{k}_{j}" for j in range(rnd.randint(0, max(1, n // 3))))])]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = list(range(len(texts)))
    for i in range(0, len(texts), 2):
        a, b = sets[i], sets[i + 1]
        if 100 * len(a & b) >= 75 * len(a | b):
            want[i + 1] = i
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want and want != list(range(len(texts)))


def test_near_duplicates_at_a_lower_threshold(spark):
    rnd, texts = random.Random(10), []
    for k in range(60):  # pairs of 60 shingles, alike by 0.39 to 0.63
        words = [f"k{k}w{i}" for i in range(64)]
        cut = rnd.randint(14, 26)
        texts += [" ".join(words), " ".join([*words[:-cut], *(f"y{k}_{j}" for j in range(cut))])]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    linked = [100 * len(a & b) >= 50 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, threshold=50, bands=120, rows=3).collect()}
    assert [got[i + 1] == i for i in range(0, len(texts), 2)] == linked and 10 < sum(linked) < 50
    assert near_dup.most_different(75) == 108


def test_linked_secrets_of_long_dense_texts():
    rnd = random.Random(11)
    mixed = lambda: "".join(rnd.choices("abcXYZ0123456789", k=24))
    some = (lambda: "user=bob", mixed, lambda: "password=hunter22", lambda: f"{rnd.getrandbits(120):030x}", lambda: f"https://h.example/{mixed()}", lambda: "key: abcd", lambda: "of the river")
    def text(n):
        return " ".join(rnd.choice(some)() for _ in range(n))
    for t in (text(n) for n in (0, 1, 2, 5, 30, 300)):
        base = secret_scan.base_spans(t)
        ends = [(m.start(), m.end()) for m in secret_scan.ENDPOINT.finditer(t)]
        weak = {s for s in secret_scan.linked_spans(t, base) if s[2] == "weak"}
        assert not any(a < w[1] and w[0] < b for w in weak for a, b in [*(s[:2] for s in base), *ends])
    long = text(60_000)  # minutes if each part were held against all others
    start = time.monotonic()
    assert len(secret_scan.scan(long)[1]) > 40_000
    assert time.monotonic() - start < 30


def test_tables_are_left_only_where_results_read_them(spark, tmp_path):
    docs = frame(spark, [(0, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h i")])
    out = near_dup.near_duplicates(docs)
    assert out.count() == 3 and common._live[-1]._kept == {"out"}
    common.release_tables()
    assert not common._live


@pytest.mark.parametrize("last", ["spark.stop()", "pass"])
def test_tables_go_when_the_driver_ends(tmp_path, last):
    code = f"""
from pyspark.sql import SparkSession
from barspark.llm import near_dup
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
out = near_dup.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string"))
assert out.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith({str(tmp_path)!r}.lstrip("/")) and out.count() == 2
{last}
"""
    root = str(Path(near_dup.__file__).parents[2])
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=root)
    assert not list(tmp_path.rglob("*.parquet"))


def test_slices_bound_rows_and_bytes():
    rnd = random.Random(7)
    texts = ["x" * rnd.choice((0, 1, 10, 90, 250)) if rnd.random() < 0.9 else None for _ in range(500)]
    batch = common.pa.RecordBatch.from_arrays([common.pa.array(range(500)), common.pa.array(texts)], names=["i", "t"])
    got = list(common.slices(iter([batch, batch.slice(0, 0)]), 40, 200))
    assert [t for g in got for t in g.column(1).to_pylist()] == texts
    assert all(0 < g.num_rows <= 40 for g in got)
    assert all(g.num_rows == 1 or sum(len(t or "") for t in g.column(1).to_pylist()) <= 200 for g in got)


def test_packing_with_ids_gets_small_batches(spark, monkeypatch):
    def checked(batches, *limits):
        def small(batch):
            assert batch.nbytes < 6 << 20
            return batch

        return common.slices(map(small, batches), *limits)

    texts = [f"{'over the hill ' * 300}{i}" for i in range(3000)]
    docs = frame(spark, enumerate(texts)).repartition(1)
    fields, key = ("doc_id", "piece", "start", "length", "ids_crc32"), "spark.sql.execution.arrow.maxBytesPerBatch"
    want, before = packing.pack_documents(docs, WORD).select(*fields).collect(), spark.conf.get(key)
    monkeypatch.setattr(packing, "slices", checked)
    got = packing.pack_documents(docs, WORD, with_ids=True).select(*fields)
    assert spark.conf.get(key) == before
    monkeypatch.undo()
    assert sorted(got.collect()) == sorted(want) and len(want) == 3000


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from Linux")
def test_packing_worker_with_ids_stays_small():
    code = f"""
import random, re
import pyarrow as pa
from barspark.llm import packing

class Shared:
    value = open({WORD!r}, encoding="utf-8").read()

class Task:
    get = classmethod(lambda cls: cls)
    partitionId = staticmethod(lambda: 0)

def used():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    rnd = random.Random(3)
    for k in range(6):  # 100,000 words that occur once
        words = [hex(rnd.getrandbits(36))[2:].translate(letters) for _ in range(100_000)]
        texts = [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])

packing.TaskContext, letters = Task, str.maketrans("0123456789", "ghijklmnop")
packing.encoder(Shared)
packing.forget_encoders()
before = used()
print(max(used() for _ in packing._pieces(Shared, 2048, 0, True, 2)(batches())) - before)
"""
    root = str(Path(__file__).parents[2])
    said = subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=root, capture_output=True, text=True).stdout
    assert float(said) < 130  # MB, the loaded encoder included
