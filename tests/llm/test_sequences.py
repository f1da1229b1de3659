"""BPE by chunks, compaction and the prefix trie against plain versions."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict
from datetime import datetime
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from parlance.llm import bpe_chunks, compaction, prefix_trie

# --- BPE -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


ODD = [
    "", " ", "\n\t", "word", "Don't STOP, it's We'll!", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>.", "x" * 9000, "é" * 5000, "é ́a", "İstanbul ΟΔΟΣ ﬁn ß ẞ", "日本語 テキスト 😀👨‍👩‍👧", "\x00\x1c\x85a b　c",
    "wort. Wort, wort! wort!!! .wort x'.s '.s 1.5,2", "a‍.", "½. ²! ٣,", "naïve—Über…«ça»", "!?" * 3000, "ab " * 4000, "tail?" + "́", "İ." * 2000, "a|>. b> c'll. d's, ’s",
]


def test_bpe_equals_library(spark, sf_dir, library):
    rng = random.Random(3)
    passage = " ".join(rng.choice(["Lorem", "ipsum,", "Äpfel", "don't", "x1y2", "--", "fin."]) for _ in range(900))
    rows = [(k, t) for k, t in enumerate(ODD)] + [(90, None), (None, "no id"), (91, passage), (91, passage), (92, "own words first " + passage + " and after"), (93, "".join(rng.choice("ab \né€𝄞.") for _ in range(30_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    docs = docs.withColumn("ids", F.lit(1)).withColumn("id", F.lit("clash"))
    got = sorted((r.doc_id is not None, r.doc_id, bytes(r.ids), r.decoded) for r in bpe_chunks.decode_ids(bpe_chunks.encode_texts(docs)).collect())
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id is not None, r.doc_id, struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    unshared = bpe_chunks.encode_texts(docs, most=0).collect()
    assert sorted(bytes(r.ids) for r in unshared) == sorted(x[2] for x in want)


def test_bpe_query_columns(spark, sf_dir, library):
    got = {r.doc_id: r for r in bpe_chunks.op11_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_chunks.decode_ids(bpe_chunks.encode_texts(docs)).collect() == []


def test_cuts_follow_content():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh éß€ \n") for _ in range(60_000)).encode()
    for raw in (text, b"", b"a" * 20_000, "é".encode() * 9000, text[:100]):
        ends = bpe_chunks.cut(raw)
        assert (ends[-1] if ends else 0) == len(raw) and ends == sorted(set(ends))
        assert all(lo < hi <= lo + bpe_chunks.MOST + 3 for lo, hi in zip([0, *ends], ends))
        assert all(hi - lo >= bpe_chunks.LEAST for lo, hi in zip([0, *ends[:-1]], ends[:-1]))
        b"".join(raw[lo:hi].decode().encode() for lo, hi in zip([0, *ends], ends))  # no character is split
    pieces = lambda raw: {raw[lo:hi] for lo, hi in zip([0, *bpe_chunks.cut(raw)], bpe_chunks.cut(raw))}
    own, shifted = pieces(text), pieces(b"another beginning " + text)
    assert len(own & shifted) >= len(own) - 3
    # blocks of hashing leave no trace
    long = text * 25
    assert len(long) > 1 << 20 and set(bpe_chunks.cut(long[: 1 << 20])[:-1]) <= set(bpe_chunks.cut(long))


def test_shared_chunks_are_those_that_save_most(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    hot, warm = " ".join(word() for _ in range(3000)), " ".join(word() for _ in range(3000))
    texts = [f"{word()} {hot} {word()}" for _ in range(30)] + [f"{word()} {warm}" for _ in range(5)] + [word() for _ in range(50)]
    found = bpe_chunks.shared_chunks(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), most=2).collect()
    e = bpe_chunks.ChunkEncoder()
    cuts = [0, *bpe_chunks.cut(texts[0].encode())]
    keys = {bpe_chunks._key(texts[0].encode()[lo:hi]) for lo, hi in zip(cuts, cuts[1:])}
    assert len(found) == 2 and {bytes(r.key) for r in found} <= keys and all(len(r.ids) > 0 for r in found)
    assert e.encode(texts[0].encode(), {bytes(r.key): bytes(r.ids) for r in found}) == e.encode(texts[0].encode(), {})


def test_vocabulary_across_white_space_is_refused():
    with pytest.raises(ValueError, match="white space"):
        bpe_chunks.ChunkEncoder("byte_bpe_50k")


# --- compaction ----------------------------------------------------------------------------------


def plain_plan(files, least, room):
    """First fit, group by group: {(day, lot, piece): first}."""
    groups = defaultdict(list)
    for day, lot, piece, n in sorted(files, key=lambda f: (f[0], -f[3], f[1], f[2])):
        if n >= least:
            continue
        for g in groups[day]:
            if sum(x[3] for x in g) + n <= room:
                g.append((day, lot, piece, n))
                break
        else:
            groups[day].append([(day, lot, piece, n)])
    return [g for gs in groups.values() for g in gs if len(g) > 1]


def test_tree_places_leftmost():
    rng = random.Random(1)
    for _ in range(50):
        sizes, room = [rng.randint(0, 40) for _ in range(rng.randint(1, 60))], 40
        tree, left = compaction.Groups(len(sizes), room), []
        for n in sizes:
            k = next((k for k, r in enumerate(left) if r >= n), len(left))
            if k == len(left):
                left.append(room)
            left[k] -= n
            assert tree.place(n) == k
    with pytest.raises(ValueError):
        compaction.Groups(3, 5).place(6)


def brute_lots(rows, total):
    """{(day, lot, piece): rows in file order} of (id, arrived, ...) rows."""
    days = Counter(None if r[1] is None else (r[1] - datetime(1970, 1, 1)).days for r in rows)
    lots = defaultdict(list)
    for r in rows:
        day = None if r[1] is None else (r[1] - datetime(1970, 1, 1)).days
        h = zlib.crc32(b"" if r[0] is None else str(r[0]).encode())
        lots[day, h // 16 % (1 + days[day] // (1 + total // 200)), min(h % 4, h // 4 % 4)].append(r)
    for part in lots.values():
        part.sort(key=lambda r: (r[1] is not None, r[1] or datetime.min, r[0] is not None, r[0] or 0))
    return lots


def local(path):
    return Path(path.removeprefix("file:"))


def test_compaction_query(spark, sf_dir):
    got = {(r.day, r.lot, r.piece): r for r in compaction.op12_compaction(spark, sf_dir).collect()}
    with duckdb.connect() as c:
        rows = c.execute(f"SELECT click_id, arrived_at, value, ts, client_id, kind, props FROM '{sf_dir}/clicks.parquet'").fetchall()
    lots = brute_lots(rows, len(rows))
    files = {k: (k, [k], v, False) for k, v in lots.items()}
    for g in plain_plan([(*k, len(v)) for k, v in lots.items()], 1 + len(rows) // 750, 1 + len(rows) // 300):
        keys = [x[:3] for x in g]
        files[keys[0]] = (keys[0], keys, [r for k in keys for r in lots[k]], True)
        for k in keys[1:]:
            del files[k]
    assert set(got) == set(files) and len({r.path for r in got.values()}) == len(got)
    assert any(r.rewritten for r in got.values()) and not all(r.rewritten for r in got.values())
    for k, (_, keys, part, rewritten) in files.items():
        r, ids = got[k], [x[0] for x in part]
        assert (r.n_rows, r.min_click_id, r.max_click_id, r.rewritten) == (len(part), min(ids), max(ids), rewritten)
        assert r.sources == ",".join(f"{lot}-{piece}" for _, lot, piece in keys)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.cents == sum(0 if x[2] is None else math.floor(100 * x[2] + 0.5) for x in part)
        assert r.columns == "click_id,ts,arrived_at,client_id,kind,value,props"
        table = pq.read_table(local(r.path), partitioning=None)
        assert ",".join(table.column_names) == r.columns and table.column("click_id").to_pylist() == ids
        assert Counter(map(repr, zip(*(table.column(n).to_pylist() for n in ("click_id", "arrived_at", "value", "ts", "client_id", "kind", "props"))))) == Counter(map(repr, part))
    root = local(next(iter(got.values())).path).parents[3]
    assert {p.resolve() for p in root.rglob("*.parquet")} == {local(r.path).resolve() for r in got.values()}


def odd_clicks(spark):
    at = datetime(2024, 1, 5, 12)
    rows = [(k % 90 or None, None if k % 7 == 0 else at.replace(day=5 + k % 3), k, f"b{k}") for k in range(600)]
    return spark.createDataFrame(rows, "click_id long, arrived_at timestamp_ntz, Day int, `lot` string")


def test_compaction_keeps_other_files_and_positions(spark):
    rows = odd_clicks(spark)
    lots = compaction.write_lots(rows, compaction.new_folder(spark, "odd"), "arrived_at", "click_id", lots=20)
    root = local(lots.root)
    before = {p: p.read_bytes() for p in root.rglob("*.parquet")}
    order = {p: pq.read_table(p, partitioning=None).to_pylist() for p in before}
    made = compaction.compact(spark, lots, small=30, full=10).collect()
    after = set(root.rglob("*.parquet"))
    name = lambda p: tuple(None if "HIVE" in x else int(x) for x in (f.rpartition("=")[2] for f in p.parts[-4:-1]))
    sources = {name(p): p for p in before}
    assert len(sources) == len(before) and any(k[0] is None for k in sources)
    assert {(r.day, r.first_lot, r.first_piece) for r in made} == {name(p) for p in after}
    for r in made:
        (path,) = [p for p in after if name(p) == (r.day, r.first_lot, r.first_piece)]
        keys = [(r.day, *map(int, s.split("-"))) for s in r.sources.split(",")]
        assert r.rewritten == (len(keys) > 1)
        if r.rewritten:
            assert pq.read_table(path, partitioning=None).to_pylist() == [x for k in keys for x in order[sources[k]]]
        else:
            assert path.read_bytes() == before[path]
    assert any(r.rewritten for r in made) and not all(r.rewritten for r in made)
    facts = compaction.file_facts(spark, lots, "click_id", F.col("Day")).collect()
    assert sum(r.n_rows for r in facts) == 600 and sum(r.cents for r in facts) == sum(range(600))
    assert {r.columns for r in facts} == {"click_id,arrived_at,Day,lot"}
    for r in facts:
        ids = [x["click_id"] for x in pq.read_table(local(r.path), partitioning=None).to_pylist()]
        assert r.ids_sha256 == hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest()
    # done again on its own result, no file is lost or doubled
    compaction.compact(spark, lots, small=30, full=10)
    assert lots.read(spark).count() == 600


def test_compaction_of_an_empty_table(spark):
    lots = compaction.write_lots(odd_clicks(spark).limit(0), compaction.new_folder(spark, "none"), "arrived_at", "click_id")
    assert compaction.compact(spark, lots).collect() == []
    assert compaction.file_facts(spark, lots, "click_id", F.lit(0)).collect() == []


# --- prefix trie ---------------------------------------------------------------------------------


def brute_trie(rows, heads=9):
    """The contract's nodes of (conv_id, turn, role, text) rows; heads=1: conversations as they are."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        seqs[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
    ends = {k: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(k)))).encode()).hexdigest() for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], ends[k]) for k, m in members.items())


def trie_rows(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def test_trie_query(spark, sf_dir):
    with duckdb.connect() as c:
        rows = c.execute(f"SELECT conv_id, turn, role, text FROM '{sf_dir}/conversations.parquet'").fetchall()
    assert trie_rows(prefix_trie.op13_prefix_trie(spark, sf_dir)) == brute_trie(rows)


def odd_conversations():
    rng = random.Random(11)
    rows = [(None, 1, "user", "nobody's"), (0, None, None, None), (0, None, None, None), (0, 3, "user", ""), (7, 1, "user", "é€𝄞"), (7, 1, "user", "é€𝄞"), (7, None, "a", "x"), (2**40, 1, "user", "hi")]
    for c in range(20, 120):  # a third shares its first turns
        rows += [(c, t, "user" if t % 2 else "assistant", f"shared {t}" if c % 3 == 0 and t < 4 else rng.choice("abc")) for t in range(rng.randint(1, 9))]
    rows += [(200, t, "user", f"deep {t % 5}") for t in range(700)] + [(201, t, "user", f"deep {t % 5}") for t in range(650)] + [(5, t, "r", "q") for t in range(3)]
    rng.shuffle(rows)
    return rows


def test_trie_of_odd_and_deep_conversations(spark):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("clash"), "digest": F.lit(1), "part": F.lit(2)}).repartition(5)
    assert trie_rows(prefix_trie.prefix_trie(*prefix_trie.rebuild(prefix_trie.order_turns(df), prefix_trie.lengths(df)))) == brute_trie(rows)
    assert trie_rows(prefix_trie.conversation_trie(df)) == brute_trie(rows, heads=1)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(df).collect() == []
    lonely = spark.createDataFrame([(9, None, None, None)], "conv_id long, turn long, role string, text string")
    built = prefix_trie.rebuild(prefix_trie.order_turns(lonely), prefix_trie.lengths(lonely))
    assert trie_rows(prefix_trie.prefix_trie(*built)) == brute_trie([(9, None, None, None)])


def test_one_conversation_spreads_over_tasks(spark):
    rows = [(1, t, "user", f"turn {t}") for t in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.order_turns(df)
        assert sorted((r["rank"], r["bytes"]) for r in turns.collect()) == [(t, len(f"turn {t}")) for t in range(4000)]
        scanned = prefix_trie._prefixes(turns.select("conv", F.col("rank").alias("pos"), "digest", "bytes", (F.col("rank") == 3999).alias("last"))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_depth = {r["depth"]: r for r in scanned}
    assert all((by_depth[d]["pa"], by_depth[d]["pb"]) == (by_depth[d - 1]["a"], by_depth[d - 1]["b"]) for d in range(2, 4001))
    assert (by_depth[1]["pa"], by_depth[1]["pb"]) == (0, 0) and len({(r["a"], r["b"]) for r in scanned}) == 4000


def test_id_lists_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 64)
    ends = spark.range(0, 3000).select(F.lit(2).cast("long").alias("depth"), (F.col("id") % 2).alias("a"), F.lit(5).cast("long").alias("b"), F.col("id").alias("conv")).repartition(7)
    got = {r["a"]: r["ends_sha256"] for r in prefix_trie._digest_ids(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(k, 3000, 2)).encode()).hexdigest() for k in (0, 1)}
