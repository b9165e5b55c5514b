import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from barspark.llm import html_extract, mixing, near_dup, oracle_sql, packing, quality, queries, secret_scan, sharding, sketch, token_count, token_store, tokens, top_k

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
DDL = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, `key` string, rep long"
KEY = "AKIA" + "Z" * 16
BASE = " ".join(f"word{i}" for i in range(80))
TEXTS = [
    None, "", " \t\n", BASE, BASE, BASE.replace("word40", "x"), BASE.upper(), "one two", "One  TWO", "a b c d e f",
    "long " * 9000, "naïve café <|endoftext|> 日本語 \x1c x", f"user: bob token = abcdef1 {KEY} https://h.example/x {'0123456789abcdef' * 2}",
    "same line\nsame line\nother $$$ ###", "pwd: hunter2 at host=db.example.com", "Σίσυφος İ ſecret=abcdefg don't 12 ½",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s" if i % 3 else None, len(t or ""), 1, "x", "k", 5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def ids_of(path, text, end):
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(docs):
    got = packing.pack_documents(docs, WORD, with_ids=True).collect()
    sequences, parts = defaultdict(list), defaultdict(dict)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"]][r["piece"]] = r
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    for i, text in enumerate(TEXTS):
        want = ids_of(WORD, text, 0)
        assert b"".join(bytes(parts[i][k]["ids"]) for k in sorted(parts[i])) == want.tobytes()
        assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["start"] == 2048 * k for k, r in parts[i].items())
    assert len(sequences) == -(-sum(len(ids_of(WORD, t, 0)) for t in TEXTS) // 2048)


def test_encoder_in_small_blocks(monkeypatch):
    monkeypatch.setattr(tokens, "GATHER_WORDS", 3)
    monkeypatch.setattr(tokens, "LOOKUP_WORDS", 2)
    with open(WORD, encoding="utf-8") as f:
        got = list(tokens.Encoder(f.read()).encode_all(pa.array(TEXTS)))
    assert [x.tolist() for x in got] == [ids_of(WORD, t, 0)[:-1].tolist() for t in TEXTS]


def test_bounded_best_fit_closes_the_fullest():
    rnd = random.Random(1)
    lengths = [rnd.randint(1, 100) for _ in range(2000)]
    for most in (1, 3, 50):
        used = defaultdict(int)
        for n, (b, at) in zip(lengths, packing.pack_lengths(lengths, 100, most), strict=True):
            assert used[b] == at
            used[b] += n
        assert max(used.values()) <= 100
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n)[0] for n in (4, 7, 9, 6)] == [0, 1, 2, 0]  # bin 1 was the fullest and closed


def test_quality(docs):
    ledger = quality.apply_policy(quality.quality_ledger(docs))
    got = by_id(ledger)
    assert (got[0]["n_words"], got[0]["base_failed"], got[0]["kept"]) == (0, True, False)
    assert got[3]["kept"] and not got[10]["kept"] and got[10]["n_repeat_words"] == 9000
    assert (got[13]["n_dup_lines"], got[13]["n_symbols"]) == (1, 6)
    table = {r["rule"]: r for r in quality.ablation(ledger).collect()}
    bits = [r["fail_bits"] & quality.mask(quality.POLICIES["v1"]) for r in got.values()]
    few = 1 << quality.RULE_NAMES.index("few_words")
    assert table["few_words"]["n_failed"] == sum(bool(b & few) for b in bits) and table["few_words"]["n_only_this"] == sum(b == few for b in bits)
    kept = quality.keep_by_policy(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_policies_read_one_written_ledger(docs, monkeypatch):
    got = by_id(quality.quality_ledger(docs))
    ledger = quality.write_ledger(docs)
    assert {r["row"]["doc_id"]: r["fail_bits"] for r in ledger.collect()} == {i: r["fail_bits"] for i, r in got.items()}
    monkeypatch.setattr(quality, "_measured", None)  # no rule is evaluated again
    for policy, rules in quality.POLICIES.items():
        kept = quality.keep_by_policy(docs, policy, ledger=ledger)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["fail_bits"] & quality.mask(rules)}


@pytest.mark.parametrize("name", ["op2_quality_rules", "op4_near_dedup", "op6_source_mixing"])
def test_against_sql(spark, docs, tmp_path, name):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = queries()[name](spark, str(tmp_path)).toPandas()
    want = con.execute(oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    show = lambda f: sorted(map(tuple, f[cols].astype(str).values.tolist()))
    assert show(got) == show(want)


def test_near_duplicates(docs):
    got = by_id(near_dup.near_duplicates(docs))
    assert [got[i]["component_id"] for i in range(9)] == [0, 1, 2, 3, 3, 3, 3, 7, 7]
    assert [got[i]["n_shingles"] for i in (0, 2, 7, 9, 10)] == [0, 0, 1, 2, 1]


def test_chain_of_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(30):  # each alike to the next, the ends unlike
        words = [*words[4:], *(f"n{k}_{j}" for j in range(4))]
        rows.append((100 - k, " ".join(words)))
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r["component_id"] for r in got.values()} == {71}


def brute_components(texts):
    """Component of every text by comparing the word shingles of all pairs."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    comp = list(range(len(texts)))
    for v in range(len(texts)):
        for u in range(v):
            both = len(sets[u] & sets[v])
            if 100 * both >= 75 * (len(sets[u]) + len(sets[v]) - both) and comp[u] != comp[v]:
                a, b = sorted((comp[u], comp[v]))
                comp = [a if c == b else c for c in comp]
    return comp


def test_near_copies_of_60_to_70_shingles(spark):
    texts = []
    for k in range(40):  # families of two whose sizes lie on both sides of 64 shingles, or on one
        words = [f"f{k}w{i}" for i in range(64 + k % 6)]
        texts += [" ".join(words), " ".join([*words, *(f"x{k}_{j}" for j in range(1 + k % 5))])]
    want = brute_components(texts)
    assert want == [i - i % 2 for i in range(80)]
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i]["component_id"] for i in range(80)] == want


def test_rows_of_the_last_star_round_are_all_compared(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", 1)
    monkeypatch.setattr(near_dup, "CROSS_A_ROW", 0)
    monkeypatch.setattr(near_dup, "CROSS_FREE", 0)
    texts = []
    for k in range(12):  # chains: each alike to the next, most of a bucket's components to another one
        words = [f"c{k}w{i}" for i in range(100)]
        for j in range(8):
            words = [*words[2:], f"c{k}n{j}a", f"c{k}n{j}b"]
            texts.append(" ".join(words))
    want = brute_components(texts)
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_sketch_does_not_depend_on_the_set_size():
    rnd = np.random.default_rng(3)
    elements = rnd.integers(0, 1 << 63, 130, dtype=np.uint64)
    for n in (60, 64, 65, 70, 130):  # the sketch of a union is the lesser coordinate of its parts
        parts = [sketch.sketch(elements[:n][k::2], 512) for k in (0, 1)]
        whole = sketch.sketch(elements[:n], 512)
        assert (np.minimum(*parts) == whole).all()


def test_token_store(spark, docs, tmp_path):
    token_store.write_token_store(docs, str(tmp_path / "s"), WORD)
    got = by_id(token_store.read_token_store(spark, str(tmp_path / "s")))
    start = 0
    for i, t in enumerate(TEXTS):
        want = ids_of(WORD, t, 1)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert token_store.fetch_ids(spark, str(tmp_path / "s"), [7, 99]) == {7: [ids_of(WORD, TEXTS[7], 1).tolist()], 99: []}


def test_sharding(spark):
    rnd = random.Random(2)
    rows = [(i, "hot text" if i % 3 == 0 else ("x" * rnd.randint(0, 400) + str(i // 2))) for i in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).select("row.doc_id", "size", "crc", "shard", "slot").collect()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 3000 and max(size.values()) - min(size.values()) < 0.05 * sum(size.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in got:
        where[r["crc"]].add(r["shard"])
    assert sum(len(w) > 1 for c, w in where.items() if c != zlib.crc32(b"hot text")) == 0


def test_mix_emits_copies(docs):
    want = Counter({r["row"]["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect()})
    mix = mixing.emit_mix(docs)
    assert mix.columns == docs.columns and Counter(r["doc_id"] for r in mix.collect()) == +want


def test_html(spark):
    page = (
        "<html><head><title>No</title></head><body><nav><a href=x>Menu item one</a></nav><div class='ad'>Buy &amp; buy now</div><article><h1>Title &amp; more</h1>"
        "<p>First <b>bold</b>\n text &eacute;<br>of some length here.<p>Second one.</article><div id=comments><p>Nice read, thank you.</p></div><footer>&copy; x</footer>"
    )
    rows = [(0, "u", page), (1, None, None), (2, "v", ""), (3, "w", "plain text only"), (4, "x", "<p>" * 5000 + "deep")]
    got = by_id(html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert got[0]["text"] == "Title & more First bold text é of some length here. Second one."
    assert [got[i]["text"] for i in (1, 2, 3, 4)] == ["", "", "plain text only", "deep"]


@pytest.mark.parametrize("body", ["<body>", "", "<body class=x>\n"])
def test_html_without_end_of_head(body):
    head = "<html><head><meta charset=utf-8><title>No title</title><noscript><img src=x>No script</noscript><style>p {}</style>"
    article = "<article><p>The first paragraph of the page.</p><p>And the second one.</p></article>"
    want = "The first paragraph of the page. And the second one."
    assert html_extract.extract(head + "</head>" + body + article) == want
    assert html_extract.extract(head + body + article) == want
    assert html_extract.extract(head + body + "Bare text of a page.") == "Bare text of a page."


@pytest.mark.parametrize("section", ["<![ x ]>", "<![foo[>", "<![foo[ x ]]>", "<![]>", "<![if !IE]>", "<![endif]-->", "<![CDATA[x]]>"])
def test_html_after_a_marked_section(section):
    page = f"<body><article><p>Text before the section.</p>{section}<p>Text after the section.</p><![endif]><p>Last text.</p></article>"
    got = html_extract.extract(page)
    assert got == "Text before the section. Text after the section. Last text."


def test_top_k(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, v.tolist(), i) for i, v in enumerate(rnd.normal(size=(1500, 8)) * 0.3)]
    rows += [(2000 + i, rows[7][1], 0) for i in range(30)] + [(5000, None, 0), (5001, [float("nan")] * 8, 0), (5002, [None] * 8, 0), (5050, [1.0], 0)]
    got = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)).collect()
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows if v and len(v) == 8 and None not in v and not np.isnan(v).any()}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_secrets(docs):
    got = by_id(secret_scan.find_secrets(docs))
    for i, text in enumerate(TEXTS):
        spans = []
        for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
            if len(m[2]) >= 6:
                spans.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
        for k, (kind, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
            spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[0]) >= least]
        base = [s for _, _, s in sorted(spans)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(filter(None, got[i]["spans"].split(",")))
    assert got[12]["n_linked"] and "weak:" in got[14]["spans"] and "endpoint:" in got[14]["spans"]
    clean = by_id(secret_scan.redact_documents(docs))
    assert KEY not in clean[12]["text"] and "hunter2" not in clean[14]["text"] and clean[3]["text"] == BASE and len(clean) == len(TEXTS)


def test_token_counts(docs):
    lib = Tokenizer.from_file(BYTE)
    got = by_id(token_count.count_tokens(docs, BYTE, chunk_bytes=300))
    for i, t in enumerate(TEXTS):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512)


def test_empty_tables(spark, empty):
    for f in (near_dup.near_duplicates, quality.quality_ledger, secret_scan.find_secrets, sharding.shard_documents, mixing.mix_sources,
              lambda d: packing.pack_documents(d, WORD), lambda d: token_store.store_and_read(d, WORD), lambda d: token_count.count_tokens(d, BYTE)):
        assert f(empty).count() == 0
    assert top_k.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("most", [0, corpus_pipeline.MOST_BROADCAST_IDS])
def test_near_dedup_stage_drops_the_same_either_way(spark, docs, monkeypatch, most):
    monkeypatch.setattr(corpus_pipeline, "MOST_BROADCAST_IDS", most)
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i in range(len(TEXTS)) if i not in (4, 5, 6, 8)]


def test_pipeline(spark, docs):
    current, names = docs.select("doc_id", "text", "lang", "source", "n_chars"), ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, "")
        assert current.columns == names, name
    kept = {i for i, t in enumerate(TEXTS) if quality.measure(t)[0] > 0 and 2 * quality.measure(t)[4] <= quality.measure(t)[0]}
    assert {r["doc_id"] for r in current.collect()} <= kept - {4, 5, 6}
    last = corpus_pipeline.STAGES[-1][1](spark, current, "")
    assert Counter(r["doc_id"] for r in last.collect()) == Counter(r["doc_id"] for r in current.collect())


def brute_quality(text):
    """Whether the policy v2 keeps a text."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(triples)
    repeated = len({i + j for i, t in enumerate(triples) if seen[t] > 1 for j in range(3)})
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or ""))
    return (
        len(w) > 0 and 2 * repeated <= len(w) and 3 * len(w) <= chars <= 10 * len(w)
        and 10 * symbols <= len(w) and 2 * (len(lines) - len(set(lines))) <= len(lines)
    )


def brute_copies(rows):
    """Copies of every row ``(id, text, lang, source, n_chars)`` in the mix."""
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    target, left = {}, 1.5 * sum(size.values())
    while True:
        level = left / sum(w for s, w in weight.items() if s not in target)
        full = [s for s in size if s not in target and level * weight[s] >= 2 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
    rate = {s: target.get(s, level * weight[s]) / size[s] for s in size}
    part = lambda i: int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / 2**52
    return [int(rate[r[3]]) + (part(r[0]) < rate[r[3]] % 1) for r in rows]


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    secrets = {  # as written, and redacted
        f"key {KEY} end": "key [SECRET] end",
        "my password = hunter2hunter ok": "my [SECRET] ok",
        f"sum {'0123456789abcdef' * 2} end": "sum [SECRET] end",
        "pwd: hunter2 at host=db.example.com end": "[SECRET] at host=db.example.com end",
        "nothing hidden here": "nothing hidden here",
    }
    texts, clean = [*TEXTS], {TEXTS[14]: "[SECRET] at host=db.example.com"}
    for k in range(30):
        raw, redacted = list(secrets.items())[k % 5]
        words = " ".join(f"t{k}w{i}" for i in range(1500 if k == 7 else 60 + k))
        for end in ("", " more") if k % 3 == 0 else ("",):  # a near copy of each third
            texts.append(f"{words} {raw}{end}")
            clean[texts[-1]] = f"{words} {redacted}{end}"
    rows = [(i, t, "en", ("s", "t", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    good = [r for r in rows if brute_quality(r[1])]
    comp = brute_components([r[1] for r in good])
    single = [r for i, r in enumerate(good) if comp[i] == i]
    assert len(rows) > len(good) > len(single) > 30
    redacted = [(r[0], x := clean.get(r[1], r[1]), r[2], r[3], len(x)) for r in single]
    mixed = [r for r, n in zip(redacted, brute_copies(redacted), strict=True) for _ in range(n)]
    pieces = []
    for r in mixed:
        ids = ids_of(WORD, r[1], 0)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048].tobytes()
            pieces.append((r[0], k, at, len(part) // 4, zlib.crc32(part), part))
    assert len(pieces) > len(mixed)

    seen, order = {}, lambda rows: sorted(rows, key=repr)

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            seen[name] = [tuple(r) for r in docs.collect()]
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for name, want in zip(("near_dedup", "secret_scans", "source_mixing", "best_fit_packing"), (good, single, redacted, mixed), strict=True):
        assert order(seen[name]) == order(want), name
    fields = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert order((*(r[f] for f in fields), bytes(r["ids"])) for r in got) == order(pieces)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        assert all(at == sum(n for _, n in sorted(s)[:i]) for i, (at, _) in enumerate(sorted(s))) and sum(n for _, n in s) <= 2048
