"""The ten operators against brute force, round trips and held-out labels, on small tables
with nulls, empty texts, repeated rows, clashing columns, and no rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from relquill.llm import chat, classify, decontam, media, mixing, quality, simhash, suffix, tokens, toxicity, warc
from relquill.llm.common import filesystem, run_dir
from relquill.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, "a"), (4, "b b b  b\n\tb"), (5, LONG), (6, LONG), (6, LONG), (None, "no id"), (7, "é" * 700), (8, "x" * 5000), (9, "Étude \x0b z"), (10, "x <|endoftext|> y<|endoftext|><|endoftext|>  \n<|endoftext"), (11, "é <|endoftext|> \U0001f600 Ω  <|endoftext|>")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", s, 0) for (i, t), s in zip(ODD, ["a", "b", None] * 9, strict=False)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("anchor", F.lit(0))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def texts(rows):
    return [(i, t or "") for i, t in rows]


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in df.select(columns).collect()) == sorted(want)


# --- 1


def test_chat_reverses_everything(spark):
    said = ["", "\\", "\\\\#", "### user:\n</turn>\n", "a\\", "#<\\<#", "é\U0001f600 <", r"\### Assistant: </turn> ok"]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate([(r, x) for x in said + [None] for r in ("user", "assistant", "o:d\nd#", None)])]
    rows += [(2, 0, "user", "tie"), (2, 0, "user", "tie")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(9)))).collect()}
    for c in (1, 2, None):
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        own = [(r or "", x or "") for k, t, r, x in rows if k == c]
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_is_assembled_in_slices(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 3000)
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c} é# {t} " * (1 + 40 * (t % 5))) for c in (1, None, 3) for t in range(40)] + [(4, 0, "assistant", "<" * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(table).collect()
    assert len(parts) > 30 and all(len(p["formatted"]) < 13_000 for p in parts if p["conv_id"] != 4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    for c in (1, None, 3, 4):
        own = [(r, x) for k, _, r, x in rows if k == c]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_without_rows(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# --- 2


def test_tokens_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokens.tokenizer_file())
    folder = run_dir(spark, "tokens")
    manifest = tokens.write_token_shards(odd, tokens.tokenizer_file(), folder, 3)
    got = tokens.read_token_shards(spark, folder, manifest).collect()
    start, order = 0, sorted(texts(ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [i for i, _ in order]
    assert len(reference.encode("x <|endoftext|> y", add_special_tokens=False).ids) == 4
    for r, (i, t) in zip(sorted(got, key=lambda r: r["start"]), order, strict=True):
        ids = reference.encode(t, add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    shards = [tokens.Shard(folder, m["name"]) for m in manifest]
    assert [len(s.get(6)) for s in shards].count(2) == 1 and not any(s.get(12345) for s in shards)
    store = tokens.TokenStore(folder, manifest)
    assert [len(store.get(k)) for k in (1, 6, 9, 0, 12345)] == [1, 2, 1, 0, 0]
    assert tokens.token_output(spark, none).count() == 0


def test_full_token_shards_are_closed(spark):
    docs = spark.createDataFrame([(k // 700, f"text {k:04d}") for k in range(2000)], "doc_id long, text string")
    folder = run_dir(spark, "tokens")
    manifest = tokens.write_token_shards(docs, tokens.tokenizer_file(), folder, 2, 512)
    assert sum(m["records"] for m in manifest) == 2000 and len(manifest) > 3 and max(m["records"] for m in manifest) < 768
    # a key's records may stand in several shards
    store = tokens.TokenStore(folder, manifest)
    assert [len(store.get(k)) for k in (0, 1, 2, 3)] == [700, 700, 600, 0]
    whole = tokens.token_output(spark, docs)
    assert sorted(map(tuple, tokens.read_token_shards(spark, folder, manifest).collect())) == sorted(map(tuple, whole.collect()))


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = np.random.default_rng(0).choice(1 << 40, 20_000, replace=False)
    number = np.arange(len(keys))
    index = tokens.PerfectIndex.build(keys, number, np.ones_like(number), number * 3, number)
    found = index.slots[index.lookup(keys)]
    assert len(index.slots) == len(keys) and (found["first"] == number).all() and (found["start"] == number * 3).all()
    assert (index.lookup(keys + (1 << 41)) >= 0).mean() < 0.001


def test_rows_of_one_id_are_split_and_read_by_key(spark):
    docs = spark.createDataFrame([(1, f"text {k % 900}") for k in range(4000)] + [(2, "same")] * 1000 + [(None, "none")], "doc_id long, text string").repartition(5)
    folder = run_dir(spark, "tokens")
    manifest = tokens.write_token_shards(docs, tokens.tokenizer_file(), folder, 8)
    assert max(m["records"] for m in manifest) < 1500
    store = tokens.TokenStore(folder, manifest)
    assert [len(store.get(k)) for k in (1, 2, 3)] == [4000, 1000, 0]
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokens.tokenizer_file())
    assert store.get(2)[999].tolist() == reference.encode("same", add_special_tokens=False).ids + [0]
    got = tokens.read_token_shards(spark, folder, manifest).collect()
    assert sorted(r["start"] for r in got)[-1] + 2 == sum(m["tokens"] for m in manifest) and len(got) == 5001


# --- 3


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    votes = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_simhash_fingerprints_and_edges(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    by_text = dict(texts(ODD))
    for r in rows:
        if r["doc_id"] is not None:
            assert r["fp"] & (1 << 64) - 1 == brute_fingerprint(by_text[r["doc_id"]])
    groups = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == len(ODD) and groups[1] == groups[2] == 1 and groups[6] == 5
    assert simhash.near_duplicates(none).count() == 0


def test_fingerprint_groups_edges(odd, none):
    rows = simhash.fingerprint_groups(odd).collect()
    by_text = dict(texts(ODD))
    assert all(r["fp"] & (1 << 64) - 1 == brute_fingerprint(by_text[r["doc_id"]]) for r in rows if r["doc_id"] is not None)
    groups = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == len(ODD) and groups[1] == groups[2] == 1 and groups[6] == 5
    assert simhash.fingerprint_groups(none).count() == 0


def test_simhash_query_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fps = [brute_fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.DISTANCE and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(d, least.get(r, d))
    want = sorted((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(rows, fps, root, strict=True))
    assert sorted(map(tuple, queries()["op3_simhash"](spark, SF).collect())) == want


@pytest.mark.parametrize("unit", [2048, 16])
def test_near_copies_against_all_pairs(spark, unit, monkeypatch):
    """Components of pairs with a 5-word Jaccard similarity of 0.8 or more, with one and with several units a key."""
    from relquill.llm import nearcopies

    monkeypatch.setattr(nearcopies, "UNIT", unit)
    rng = np.random.default_rng(8)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    docs = []
    for k in range(25):
        base = some(int(rng.integers(60, 300)))
        for edits in (0, 1, 2, 3, 4):
            own = list(base)
            for at in rng.integers(0, len(own), edits * len(own) // 100):
                own[at] = f"e{rng.integers(1 << 30)}"
            docs.append(" ".join(own))
    crowd = some(120)
    for _ in range(60):
        own = list(crowd)
        for at in rng.integers(0, len(own), int(rng.integers(0, 5))):
            own[at] = f"e{rng.integers(1 << 30)}"
        docs.append("  ".join(own).upper())
    # copies that are near their original and not each other, whoever is the centre of their keys
    spread = some(200)
    docs.append(" ".join(spread))
    for _ in range(60):
        own = list(spread)
        for at in rng.integers(0, len(own), int(rng.integers(2, 5))):
            own[at] = f"e{rng.integers(1 << 30)}"
        docs.append(" ".join(own))
    sets = [frozenset(zip(*(t.lower().split()[j:] for j in range(5)), strict=False)) for t in docs]
    pairs = [(i, j) for j in range(len(docs)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = list(range(len(docs)))
    for i, j in pairs:
        root = [root[i] if r == root[j] else r for r in root]
    got = {r["row"]: r["component"] for r in nearcopies.near_copies(spark.createDataFrame(list(enumerate(docs)), "row long, text string")).collect()}
    assert len(pairs) > 300 and sum(got[i] == got[j] for i, j in pairs) >= 0.999 * len(pairs)
    assert all(root[i] == root[j] for i in got for j in got if got[i] == got[j])


def test_near_copies_that_fingerprints_and_pivots_miss(spark):
    """Pairs at exactly 0.8 that are beyond the radius, or have no key in common."""
    from relquill.llm import nearcopies

    numbers = [
        [738374284, 663522843, 774662876, 738735239, 630509414, 309355902, 555274285, 990872478, 85896759],
        [662677076, 540122104, 855600630, 98700496, 754112587, 936929615, 773727664, 279231759, 845017411],
        [946260742, 467475168, 508914122, 301985088, 899220354, 678664829, 429946497, 267924205, 623065395, 848737873, 315030644, 775615266, 60963029, 27708738],
    ]
    words = [[f"w{x}" for x in own] for own in numbers]
    docs = [" ".join(own[:n]) for own in words for n in (len(own) - (len(own) - 4) // 5, len(own))]
    sets = nearcopies.split_sets(*nearcopies.word_shingles(np.frombuffer("".join(docs).encode(), np.uint8), np.cumsum([0, *map(len, docs)]))[1:])
    voted = nearcopies.votes(sets)
    prints, keys = nearcopies.simhash(voted), nearcopies.pivot_keys(voted)
    for k in range(0, len(docs), 2):
        assert 5 * len(sets[k]) == 4 * len(sets[k + 1]) and np.isin(sets[k], sets[k + 1]).all()
        assert np.bitwise_count(prints[k] ^ prints[k + 1]).sum() > nearcopies.RADIUS or not (keys[k] == keys[k + 1]).any()
    got = {r["row"]: r["component"] for r in nearcopies.near_copies(spark.createDataFrame(list(enumerate(docs)), "row long, text string")).collect()}
    assert len(set(got.values())) == 3 and all(got[k] == got[k + 1] for k in range(0, len(docs), 2))


@pytest.mark.parametrize(("unit", "often", "frequent"), [(1024, 64, 1 << 20), (8, 2, 1 << 20), (8, 2, 10)])
def test_missed_pairs_are_all_similar_pairs(spark, unit, often, frequent, monkeypatch):
    """Without any component the exact search alone names every pair at 0.8, with shared passages, sizes across powers of two and few keys frequent."""
    from relquill.llm import nearcopies

    for name, value in (("UNIT", unit), ("OFTEN", often), ("FREQUENT", frequent)):
        monkeypatch.setattr(nearcopies, name, value)
    rng = np.random.default_rng(11)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 30, n)]
    passage, docs = some(40), ["", "a", "a b c"]
    for size in (5, 8, 13, 20, 36, 67, 68, 69, 130, 260, 1100, 5200):
        for _ in range(3):
            base = some(size) + (passage if size > 20 else [])
            docs += [" ".join(base), " ".join(base + some(1)), " ".join(base + some((len(base) - 4) // 4)), " ".join(base + some((len(base) - 4) // 4 + 1)), " ".join(base[len(base) // 5 :])]
    docs = list(dict.fromkeys(docs))
    texts = spark.createDataFrame(list(enumerate(docs)), "row long, text string")
    classes, n, shingles = nearcopies.word_shingles(np.frombuffer("".join(docs).encode(), np.uint8), np.cumsum([0, *map(len, docs)]))
    sets, names = [set(x.tolist()) for x in nearcopies.split_sets(n, shingles)], classes.view(np.int64).tolist()
    pairs = {(max(names[i], names[j]), min(names[i], names[j])) for j in range(len(docs)) for i in range(j) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    got = {(r["a"], r["b"]) for r in nearcopies.missed(texts, spark.createDataFrame([], "node long, root long")).collect()}
    assert len(pairs) > 60 and pairs <= got and len(got) < 3 * len(pairs)


def test_near_copies_are_named_by_simhash_and_pivots(spark, monkeypatch):
    """The pipeline's stage goes through fingerprints and nearest pivots, held against their definition."""
    import corpus_pipeline as p
    from relquill.llm import nearcopies

    passed = []
    signed, pairs = nearcopies.signed_rows, nearcopies.close_pairs
    monkeypatch.setattr(nearcopies, "signed_rows", lambda *a: passed.append(("rows", signed(*a))) or passed[-1][1])
    monkeypatch.setattr(nearcopies, "close_pairs", lambda *a: passed.append(("pairs", pairs(*a))) or passed[-1][1])
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 3000, 300)]
    # an edit changes five of 296 shingles: five edits leave 0.85, twelve 0.66
    edited = lambda n: " ".join("e" if n and k in range(12, 12 + 20 * n, 20) else w for k, w in enumerate(base))
    docs = [edited(0), edited(5), edited(12), "", "four words are enough", "A  four words ARE"]
    kept = p.one_of_each(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], DOCS), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4, 5]
    assert {name for name, _ in passed} == {"rows", "pairs"}
    assert next(df for name, df in passed if name == "pairs").count() >= 1

    _, n, shingles = nearcopies.word_shingles(np.frombuffer("".join(docs).encode(), np.uint8), np.cumsum([0, *map(len, docs)]))
    pivots = nearcopies._PIVOTS.T.reshape(nearcopies.TABLES, nearcopies.PER, nearcopies.PIVOTS, nearcopies.BITS)
    sets = nearcopies.split_sets(n, shingles)
    voted = nearcopies.votes(sets)
    for own, got, prints, keys in zip(sets, voted, nearcopies.simhash(voted), nearcopies.pivot_keys(voted), strict=True):
        hashes = nearcopies.mix((own[:, None] + nearcopies._VOTE[:4]) * nearcopies._VOTE[:4]).view(np.uint8)
        votes = (2 * np.unpackbits(hashes).reshape(-1, nearcopies.BITS).astype(int) - 1).sum(axis=0)
        assert got.tolist() == votes.tolist() and np.unpackbits(prints.view(np.uint8)).tolist() == (votes > 0).tolist()
        # distance to a pivot: the votes of the bits that differ; to its complement: of those that agree
        apart = np.where((votes > 0) == (pivots > 0), 0, abs(votes)).sum(axis=-1)
        least = np.minimum(apart, abs(votes).sum() - apart).min(axis=-1)
        if len(own):
            codes = keys - np.arange(nearcopies.TABLES) * (2 * nearcopies.PIVOTS) ** nearcopies.PER
            for j in range(nearcopies.PER):
                code = codes // (2 * nearcopies.PIVOTS) ** j % (2 * nearcopies.PIVOTS)
                chosen = apart[np.arange(nearcopies.TABLES), j, code // 2]
                assert (np.where(code % 2, chosen, abs(votes).sum() - chosen) == least[:, j]).all()


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Rows of one id with other texts, and rows without an id."""
    import corpus_pipeline as p

    clean, other = " ".join(f"c{i}" for i in range(80)), " ".join(f"o{i}" for i in range(80))
    near = clean.replace("c79", "x")
    rows = [(1, clean), (2, near), (2, other), (None, "no id here"), (None, "no id here"), (None, near), (3, None), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("row", F.lit("own"))
    got = p.one_of_each(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in got.collect())) == sorted([(1, clean), (2, other), (0, "no id here"), (3, "")])


@pytest.mark.parametrize("group", [simhash.GROUP, 8])
def test_simhash_links_are_complete(spark, group, monkeypatch):
    """Chains and dense clusters, with and without the second deal of large groups."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 300)}
    for centre in list(fps)[:10]:
        at = centre
        for _ in range(30):
            at ^= 1 << int(rng.integers(64))
            at ^= (1 << int(rng.integers(64))) * int(rng.integers(2))
            fps.add(at)
    signed = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in fps)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.link_table(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    assert {x: roots.get(x, x) for x in signed} == {x: find(x) for x in signed}


# --- 4


def test_media_round_trip(spark, odd, none):
    folder = run_dir(spark, "features")
    manifest = media.write_features(media.store_audio(odd), folder)
    rows = media.read_features(spark, folder, manifest).collect()
    by_text = dict(texts(ODD))
    assert len(rows) == len(ODD) == sum(r["rows"] for r in manifest)
    for r in rows:
        raw = (by_text[r["doc_id"]] if r["doc_id"] is not None else "no id").encode()
        payload = raw + b"\xff" * ((-len(raw) % 576) or (0 if raw else 576))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_sha256"] == hashlib.sha256(media.wav(payload)).hexdigest() and r["media_bytes"] == len(payload) + 44
        assert len(r["tensor"]) == media.BINS * media.BANDS
    same = [tuple(r)[1:] for r in rows if r["doc_id"] in (5, 6)]
    assert same[0] == same[1] == same[2]
    fs, base = filesystem(folder)
    with fs.open_input_stream(f"{base}/{manifest[0]['name']}") as stream, pa.ipc.open_stream(stream) as reader:
        table = reader.read_all()
    assert table.schema.field("tensor").type.shape == list(media.SHAPE)
    told = {r["doc_id"]: r["feature"] for r in media.read_features(spark, folder, manifest, described_too=True).collect()}
    one = next(r for r in rows if r["doc_id"] == 7)
    picture = np.array(one["tensor"]).reshape(media.SHAPE)
    assert told[7].split(";")[0] == f"frames={one['frames']}" and told[7].endswith("bands=" + ",".join(str(int(np.rint(x))) for x in picture.mean(axis=0)))
    assert media.audio_features(none).count() == 0


def brute_features(payload):
    """The definition, sample by sample: fill in zeros, filter, take each third; frames; a state that opens and closes."""
    reach = media.SIDE * 3
    t = np.arange(-reach, reach + 1)
    taps = np.sinc(t / 3) * np.kaiser(len(t), 5.0)
    taps *= 2 / taps.sum()
    up = np.zeros(2 * len(payload))
    up[::2] = (payload.astype(float) - 128) / 128
    y = np.convolve(up, taps)[reach : reach + len(up)][::3]
    frames = [y[k : k + 256] for k in range(0, len(y) - 255, 128)]
    window, bank = media._mel()
    picture = np.array([10 * np.log10(np.abs(np.fft.rfft(f * window)) ** 2 @ bank + 1e-8) for f in frames])
    level = [10 * np.log10((f**2).mean() + 1e-10) for f in frames]
    on, out = False, []
    for k, x in enumerate(level):
        was, on = on, x >= np.mean(level) + media.OPEN_DB or on and x >= np.mean(level) + media.CLOSE_DB
        if on and not was:
            out.append([k, k + 1])
        elif on:
            out[-1][1] = k + 1
    n = len(frames)
    bins = [picture[k * n // 8 : max(k * n // 8 + 1, (k + 1) * n // 8)].mean(axis=0) for k in range(8)]
    return n, [[a * 0.016, b * 0.016] for a, b in out], np.array(bins)


@pytest.mark.parametrize("frames", [4096, 7])
def test_media_features_by_definition(frames, monkeypatch):
    """Also where a clip is analysed in many pieces: no seams."""
    monkeypatch.setattr(media, "FRAMES", frames)
    rng = np.random.default_rng(12)
    for size in (1, 3, 40, 200):
        loud = np.repeat(rng.integers(1, 100, size * 4), 144)
        payload = (128 + loud * np.sin(np.arange(size * 576) * 0.3 * rng.random()) + rng.integers(-2, 3, size * 576)).astype(np.uint8)
        n, a, b, tensor = media.analyse(payload)
        want_n, want, bins = brute_features(payload)
        assert n == want_n and np.allclose(np.stack([a, b], axis=1), np.array(want).reshape(-1, 2))
        assert np.allclose(tensor, bins, atol=0.02)


def test_resampling_keeps_a_tone():
    t = np.arange(12_000) / media.RATE
    y = media.resample(np.rint(128 + 100 * np.sin(2 * np.pi * 440 * t)).astype(np.uint8))
    want = 100 / 128 * np.sin(2 * np.pi * 440 * np.arange(len(y)) / media.RATE_OUT)
    assert len(y) == 8000 and np.abs(y[100:-100] - want[100:-100]).max() < 0.02
    assert np.array_equal(media.resample(np.full(9000, 7, np.uint8), 100, 5000), media.resample(np.full(9000, 7, np.uint8))[100:5000])


def test_hysteresis_holds_between_thresholds():
    a, b = media.spans(np.array([0, 10, 5.1, 5.1, 0, 5.1, 10.0, 0]))
    assert a.tolist() == [1, 6] and b.tolist() == [4, 7]


# --- 5 and 10


def auc(score, y):
    """The chance that a positive row scores above a negative one, ties half."""
    above = sum((score[y == 0] < s).sum() + 0.5 * (score[y == 0] == s).sum() for s in score[y == 1])
    return above / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize(("name", "label", "parts", "held", "cut"), [("op5_quality", "quality", 5, 0, 0.3), ("op10_toxicity", "toxic", 3, 1, 0.7)])
def test_classifiers_on_held_out_rows(spark, name, label, parts, held, cut):
    """Ranking, recall and precision at the threshold, and calibration, of rows that were not learnt."""
    sf = "/root/testdata/sf0.1"
    rows = queries()[name](spark, sf)
    seen = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held) and r["predicted"] == (r["score"] >= cut) for r in seen)
    own = [r for r in seen if r["held_out"]]
    y, score = np.array([r[label] for r in own]), np.array([r["score"] for r in own])
    found = score >= cut
    share = y.mean()
    assert ((0 <= score) & (score <= 1)).all() and auc(score, y) > 0.96
    assert found[y == 1].mean() > 0.68 and y[found].mean() > 0.93 and (found == y).mean() > max(share, 1 - share) + 0.04
    # probabilities: far nearer to the labels than their share, and neither too high nor too low among ten bins
    assert ((score - y) ** 2).mean() < 0.4 * share * (1 - share)
    bins = np.minimum((score * 10).astype(int), 9)
    assert sum(abs(score[bins == b].sum() - y[bins == b].sum()) for b in range(10)) / len(y) < 0.06


def test_scores_of_a_larger_vocabulary(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} and word{k % 11} more") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 7 < 3)) for k in range(60)], "doc_id long, quality int")
    got = quality.scored(docs, labels, lambda k: F.lit(True), vocab=1 << 15).collect()
    assert len(got) == 60 and all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_without_labels_or_rows(spark, odd, none, module):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    # the tables have a text column named like the score: it gives way
    rows = module.scored(odd, labels, lambda k: F.lit(True)).select("doc_id", "anchor", "score").collect()
    assert len(rows) == len(ODD) and all(r["score"] == 0.5 for r in rows)
    assert module.scored(none, labels, lambda k: F.lit(True)).count() == 0
    few = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["mine"] <= 1 for r in module.scored(odd, few, lambda k: F.lit(True), "mine").collect())


def test_repeated_ids_are_learnt_once(spark):
    docs = spark.createDataFrame([(1, f"copy {k % 7}") for k in range(500)] + [(2, "b"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (4, 1)], "doc_id long, toxic int")
    rows = classify.labelled(docs, labels, "toxic", lambda k: F.lit(True), 10)
    got = classify.training_rows(rows, lambda texts: [(t or "").encode() for t in texts.to_pylist()])
    assert [(bytes(r["x"]), r["y"]) for r in got] == [(b"", 0), (b"copy 0", 1)]


# --- 6


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k, kind = int(rng.integers(len(out))), rng.integers(3)
        letter = chr(97 + int(rng.integers(26)))
        if kind == 0:
            out[k] = letter
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, letter)
    return "".join(out)


def test_leaks_with_edits_reach_recall():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words, n))
    items = decontam.Items([(k, some(25)) for k in range(60)] + [(60, None), (61, "short")])
    plain = [t.tobytes().decode() for t in items.texts]
    assert len(plain) == 60
    hit = 0
    for k in range(60):
        most = decontam.allowed(len(plain[k]))
        for edits in (0, most // 2, most):
            found = decontam.batch_leaks(pa.array([f"{some(60)} {edited(rng, plain[k], edits)} {some(60)}", some(200), None, ""]), items)
            hit += any(f[0] == 0 and f[1] == k for f in found)
            assert all(f[0] == 0 for f in found)
    assert hit / 180 >= 0.95


def test_leaks_at_fixed_edit_shares():
    """Recall at shares that are not read from the module, short items, and case of all letters."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words, n))
    plain = [some(int(n)) for n in rng.integers(12, 60, 60)]
    items = decontam.Items(list(enumerate(plain)))
    for share in (0, 0.067, 0.08, 0.1):
        docs = [f"{some(60)} {edited(rng, p, int(share * len(p)))} {some(60)}" for p in plain]
        found = {(d, items.ids[o]) for d, o, *_ in decontam.batch_leaks(pa.array(docs), items)}
        assert sum((k, k) in found for k in range(60)) >= 0.95 * 60, share
    short = ["What is 6x7?", "Name the twelfth president", "élan vital of the Straße"]
    items = decontam.Items(list(enumerate(short)))
    for k, t in enumerate(short):
        for own in (t, t.upper(), t[:4] + t[5:]):
            for before in ("", "Été İ ſ ", "zz " * 50):
                doc = f"{before}{own} qq"
                found = [f for f in decontam.batch_leaks(pa.array([None, doc]), items) if items.ids[f[1]] == k]
                assert found, (doc, k)
                if own != t[:4] + t[5:]:
                    assert doc.encode()[found[0][2] : found[0][3]] == own.encode() and found[0][4] == 0
    long = "À l'été, où l'élève préféré était né, la forêt brûlée s'étend déjà près du château"
    assert [r[1:] for r in decontam.batch_leaks(pa.array([f"Ça {long.upper()} là"]), decontam.Items([(1, long)]))] == [(0, 4, 4 + len(long.encode()), 0)]


def test_leaks_of_long_items(monkeypatch):
    """Beyond COINS the walks repeat their coins, above LONG bytes items are verified directly."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(500)]
    some = lambda n: " ".join(rng.choice(words, n))
    monkeypatch.setattr(decontam, "COINS", 256)
    monkeypatch.setattr(decontam, "EMBEDDED", 1 << 14)
    for n, long in ((500, 1 << 15), (1500, 4096)):
        monkeypatch.setattr(decontam, "LONG", long)
        plain = [some(n) for _ in range(3)]
        items = decontam.Items(list(enumerate(plain)))
        assert len(items.walk_bits[0]) == 256
        docs = [f"{some(60)} {edited(rng, p, 20)} {some(60)}" for p in plain] + [some(3 * n)]
        found = decontam.batch_leaks(pa.array(docs), items)
        assert [(d, items.ids[o]) for d, o, *_ in found] == [(0, 0), (1, 1), (2, 2)] and all(r[4] <= 20 for r in found)


def test_item_blocks_are_bounded_in_bytes(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"item {k} " * 40) for k in range(40)] + [(40, None)], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4000)
    blocks = list(decontam.item_blocks(bench))
    assert len(blocks) > 2 and sum(len(b.ids) for b in blocks) == 40
    # repeated items are one
    again = bench.unionByName(spark.range(3000).select(F.col("id").alias("item_id"), F.lit("the same item " * 9).alias("text")))
    assert max(len(b.ids) for b in decontam.item_blocks(again)) < 40 and sum(len(b.ids) for b in decontam.item_blocks(again)) == 41


def test_every_copy_is_reported_where_it_stands(spark, monkeypatch):
    """Copies side by side and apart, edited or not, of long and short items; with few and many places held at once."""
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(600)]
    some = lambda n: " ".join(rng.choice(words, n))
    plain = [some(9), some(12), some(40), some(5)[:30], "ab" * 30, "x" * 50]
    for counted in (decontam.COUNTED, 60):
        monkeypatch.setattr(decontam, "COUNTED", counted)
        items = decontam.Items(list(enumerate(plain)))
        for k, p in enumerate(plain[:4]):
            most = decontam.allowed(len(p))
            parts, want = [some(30)], []
            for edits in (0, 0, 0, most // 2, most // 2):
                copy = edited(rng, p, edits)
                at = len(" ".join(parts)) + 1
                parts.append(copy)
                want.append((at, at + len(copy), edits))
            parts += [some(30), p]
            want.append((len(" ".join(parts)) - len(p), len(" ".join(parts)), 0))
            got = [r[2:] for r in decontam.batch_leaks(pa.array(["", " ".join(parts)]), items) if items.ids[r[1]] == k]
            assert len(got) == len(want), (k, got, want)
            for (a, b, n), (x, y, edits) in zip(got, want, strict=True):
                assert n <= edits and abs(a - x) <= most and abs(b - y) <= most and (edits or (a, b) == (x, y))
        # texts of one repeated string: whole copies end to end
        for k, doc, size in ((4, "ab" * 150, 60), (5, "x" * 260, 50)):
            got = [r[2:] for r in decontam.batch_leaks(pa.array([doc]), items) if items.ids[r[1]] == k]
            assert got[0] == (0, size, 0) and len(got) == len(doc) // size and all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
    docs = spark.createDataFrame([(1, f"{plain[0]} {plain[0]}")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, plain[0]), (6, plain[0]), (7, None), (8, "")], "item_id long, text string")
    n = len(plain[0])
    assert sorted(map(tuple, decontam.leaks(docs, bench).collect())) == [(1, i, a, a + n, 0) for i in (5, 6) for a in (0, n + 1)]


def test_edit_matches_against_a_table():
    rng = np.random.default_rng(5)
    for _ in range(60):
        p, t = (bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (7, 20))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        best = min(row)
        assert decontam.near_ends(p, t, best) == [(j, best) for j, x in enumerate(row) if x == best and j]
        assert min(x for _, x in decontam.near_ends(p, t, 99)) == min(row[1:])


def test_leaks_query_finds_all_exact_passages(spark, odd, none):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in bench.collect() if b["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert want <= got
    assert decontam.decontaminated(docs, bench).count() == docs.count() - len({d for d, _ in got})
    assert decontam.leaks(odd, bench).count() == 0 and decontam.decontaminated(odd, bench).count() == len(ODD)
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(none, bench).count() == 0


# --- 7


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full


def test_mixing_targets_and_words(spark, none):
    rng = np.random.default_rng(7)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 200))), "en", s, 0) for k, s in enumerate(["tiny"] * 3 + ["hot"] * 900 + ["b"] * 60 + [None] * 60 + ["é"] * 60)]
    rows += [(5000 + k, None, "en", "b", 0) for k in range(3)] + [(9, " \t\n x\x0by ", "en", "hot", 0)] * 2
    out = mixing.mixed(spark.createDataFrame(rows, DOCS))
    again = mixing.mixed(spark.createDataFrame(rows, DOCS))
    assert sorted(out.collect()) == sorted(again.collect())
    got = out.join(spark.createDataFrame(rows, DOCS).select("doc_id", "source").distinct(), "doc_id").collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    for s, size in sizes.items():
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and r["source_size"] == size for r in own)
        assert all(0 <= r["copies"] <= 3 for r in own)
        assert abs(sum(r["copies"] * r["size"] for r in own) - want[s]) <= max(r["size"] for r in own)
    assert mixing.mixed(none).count() == 0


def test_hot_values_join_like_any_other(spark, monkeypatch):
    """Null, hot and rare values, values without a row in the table, no rows: as a plain join has them."""
    from relquill.llm import common

    rows = [(k, None) for k in range(40)] + [(k, "hot") for k in range(50)] + [(k, f"v{k % 30}") for k in range(60)] + [(7, "stray")]
    counts = Counter(v for _, v in rows if v != "stray")
    left = spark.createDataFrame(rows, "id long, v string")
    table = spark.createDataFrame([(v, n, f"of {v}") for v, n in counts.items()], "v string, n long, name string")
    for hot in (1, 4, common.HOT):
        monkeypatch.setattr(common, "HOT", hot)
        got = common.join_hot(left, table, ("v",), "n")
        assert got.columns == ["id", "v", "n", "name"]
        assert Counter(map(tuple, got.collect())) == Counter((k, v, counts[v], f"of {v}") for k, v in rows if v in counts)
    assert common.join_hot(left, table.limit(0), ("v",), "n").count() == 0 == common.join_hot(left.limit(0), table, ("v",), "n").count()


def test_mixing_splits_cells_of_one_id(spark, monkeypatch):
    """Rows that share an id and a size are ranked in sub-cells like others, and every word is spent."""
    monkeypatch.setattr(mixing, "RANK_ROWS", 64)
    seen = []
    keep = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, name: (seen.append((name, keep(df, name))), seen[-1][1])[1])
    rows = [(None, "w " * 5, "en", "hot", 0)] * 3000 + [(7, "w " * 5, "en", "hot", 0)] * 500 + [(k, f"w{k} " * 30, "en", "b", 0) for k in range(100, 900)] + [(1, LONG, "en", "c", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7).withColumn("copies", F.lit("clash"))
    out = mixing.mixed(docs).collect()
    cells = [df for name, df in seen if name == "sub-cells"]
    assert len(cells) == 2 and cells[1].agg(F.max("m")).first()[0] <= 3 * 64 < cells[0].agg(F.max("m")).first()[0]
    want = brute_targets({"hot": 17_500, "b": 24_000, "c": 30_000})
    for source, size in (("hot", 5), ("b", 30), ("c", 30_000)):
        own = [r for r in out if r["size"] == size]
        assert abs(sum(r["copies"] * size for r in own) - want[source]) <= size


# --- 8


def test_warc_chunks_revisits_and_ties(spark):
    big = "é" * 1_500_000
    rows = [(5, "u", "same"), (3, "u\r\nX: y", "same"), (3, "u", "same"), (None, None, "same"), (7, "v", big), (8, "w", None), (9, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = run_dir(spark, "warc")
    chunks = warc.read_warc(spark, folder, warc.write_warc(pages, folder)).collect()
    last = [r for r in chunks if r["last"]]
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in last) == sorted([("5", "revisit", 3), ("3", "response", None), ("3", "revisit", 3), ("None", "revisit", 3), ("7", "response", None), ("8", "response", None), ("9", "revisit", 8)])
    import gzip

    fs, base = filesystem(folder)
    names = {r["record_id"]: r for r in last}
    raw = b"".join(gzip.decompress(fs.open_input_file(f.path).read()) for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".gz"))
    referred = re.findall(rb"WARC-Record-ID: (\S+)\r\n(?:(?!\r\n).*\r\n)*?WARC-Refers-To: (\S+)\r\n", raw)
    assert len(referred) == 4 and all(names[b.decode()]["record_type"] == "response" and names[b.decode()]["page_id"] == names[a.decode()]["refers_to"] for a, b in referred)
    own = sorted((r for r in chunks if r["page_id"] == 7), key=lambda r: r["chunk"])
    assert len(own) == 3 and b"".join(r["data"] for r in own) == big.encode() and own[-1]["bytes_so_far"] == 3_000_000
    assert all(r["digest_so_far"] == warc.base32(hashlib.sha1({7: big}.get(r["page_id"], "same" if r["bytes_so_far"] else "").encode()).digest()) for r in last)
    assert warc.read_warc(spark, folder, warc.write_warc(pages.limit(0), run_dir(spark, "warc"))).count() == 0


# --- 9


def brute_cut(rows):
    w = suffix.WINDOW
    seen = Counter(t[k : k + w] for t in rows for k in range(len(t) - w + 1))
    out = []
    for t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - w + 1):
            if seen[t[k : k + w]] > 1:
                gone[k : k + w] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("crowd", [suffix.CROWD, 2])
def test_suffix_cuts_what_repeats(spark, crowd):
    rng = np.random.default_rng(9)
    fresh = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passage, line = fresh(320), fresh(70)
    rows = [fresh(150) + passage + fresh(int(rng.integers(10, 300))) for _ in range(25)] + [(line + "\n") * 9, "ab" * 400, fresh(199), "", None, passage[:199], fresh(400)]
    rows += [rows[0], rows[0], fresh(50) + rows[1][:230] + fresh(40)]
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(rows)], "doc_id long, text string").withColumn("place", F.lit(1))
    got = suffix.without_repeats(docs, crowd=crowd).collect()
    raw = [(t or "").encode() for t in rows]
    want = [(k // 2, len(t), int(g.sum()), bytes(np.frombuffer(t, np.uint8)[~g])) for k, (t, g) in enumerate(zip(raw, brute_cut(raw), strict=True))]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got) == sorted(want)
    assert suffix.without_repeats(docs.limit(0)).count() == 0


def test_suffix_long_texts_are_cut_in_slices(monkeypatch):
    data = np.random.default_rng(2).integers(97, 110, 9000).astype(np.uint8)
    whole = [np.concatenate(x) for x in zip(*suffix.text_contexts(data, np.array([0, 9000])), strict=True)]
    monkeypatch.setattr(suffix, "SLICE", 1000)
    parts = [np.concatenate(x) for x in zip(*suffix.text_contexts(data, np.array([0, 9000])), strict=True)]
    assert whole[2].sum() == parts[2].sum() == 9000 - suffix.WINDOW + 1
    assert set(whole[3].tolist()) == set(parts[3].tolist())


@pytest.mark.parametrize("compared", [1 << 15, 50])
def test_index_family_marks_across_levels(compared, monkeypatch):
    """Windows of contexts that share anchors, batch by batch, against all windows."""
    monkeypatch.setattr(suffix, "COMPARED", compared)
    rng = np.random.default_rng(1)
    some = lambda n: rng.integers(97, 123, n).astype(np.uint8)
    grams, sides = [some(32) for _ in range(5)], [(some(168), some(168)) for _ in range(6)]
    bodies, lefts, again = [], [], []
    for _ in range(700):
        left, right = (x.copy() for x in sides[rng.integers(6)])
        for side in (left, right):
            if rng.random() < 0.7:
                side[rng.integers(168)] ^= 1
        p = int(rng.integers(0, 169))
        count = int(rng.integers(1, p + 2))
        whole = np.concatenate([left[168 - p :], grams[rng.integers(5)], right])
        bodies.append(whole[: count + 199])
        lefts.append(p)
        again.append(bool(rng.random() < 0.02))
    family = suffix.IndexFamily()
    for k in range(0, 700, 50):
        part = bodies[k : k + 50]
        ends = np.concatenate([[3], 3 + np.cumsum([len(x) for x in part])])
        family.add(np.concatenate([some(3), *part]), ends, np.array(lefts[k : k + 50]), np.array(again[k : k + 50]))
    seen = Counter((p - o, x[o : o + 200].tobytes()) for x, p in zip(bodies, lefts, strict=True) for o in range(len(x) - 199))
    want = [[twice or seen[p - o, x[o : o + 200].tobytes()] > 1 for o in range(len(x) - 199)] for x, p, twice in zip(bodies, lefts, again, strict=True)]
    got = [x.tolist() for x in family.marked()]
    assert got == want and 0.1 < np.mean([x for row in want for x in row]) < 0.9
    assert [x is not None for x in family.levels] == [False, True, True, True]  # 14 batches
    assert all(len(level.order) == 50 << k for k, level in enumerate(family.levels) if level is not None)


@pytest.mark.parametrize(("batch", "family"), [(3, 10), (2, 1000)])
def test_suffix_families_of_many_batches(spark, batch, family, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH", batch)
    monkeypatch.setattr(suffix, "FAMILY", family)
    rng = np.random.default_rng(3)
    fresh = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passages = [fresh(int(n)) for n in rng.integers(190, 420, 12)]
    rows = [fresh(int(rng.integers(0, 120))) + passages[rng.integers(12)][int(rng.integers(0, 60)) :] + fresh(int(rng.integers(0, 120))) for _ in range(120)]
    got = suffix.without_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    want = [(k, int(g.sum()), bytes(np.frombuffer(t.encode(), np.uint8)[~g])) for k, (t, g) in enumerate(zip(rows, brute_cut([t.encode() for t in rows]), strict=True))]
    assert sorted((r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in got) == want


# --- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in p.STAGES[:-1]:
        before, seen = seen, spark.createDataFrame(stage(spark, seen, SF).collect(), docs.schema)
        assert seen.columns == docs.columns and set(seen.collect()) <= set(before.collect()), name
        if name == "simhash":
            kept = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert sorted(r["doc_id"] for r in seen.collect()) == sorted(kept)
    out = p.STAGES[-1][1](spark, seen, SF)
    assert out.count() == seen.count()


def test_pipeline_stages_on_odd_tables(spark, odd, none):
    """Nulls, empty and long texts, repeated rows, no rows, and columns named like those that the stages add."""
    import corpus_pipeline as p

    extra = ("row", "copies", "component", "cls", "toxicity", "document", "number", "deal", "sub", "fp", "key", "tie", "a.b")
    clashing = odd.select("*", *(F.lit(c).alias(c) for c in extra))
    few = {"toxicity": len(ODD), "simhash": len(ODD) - 3, "decontamination": len(ODD)}
    for name, stage in p.STAGES:
        rows = stage(spark, clashing, SF).collect()
        assert stage(spark, clashing.limit(0), SF).count() == 0, name
        if name != "tokens":
            assert rows[0].__fields__ == clashing.columns, name
            # the table of odd texts is in the order of its rows: null, empty and equal texts are one group
            assert len(rows) == few.get(name, len(rows)) and {r["doc_id"] for r in rows} <= {i for i, _ in ODD}
        else:
            assert len(rows) == len(ODD)
