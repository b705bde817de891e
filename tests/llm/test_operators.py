"""Operators against brute force, on texts with nulls, ties, repeats, empty and long texts, and extra columns."""

import hashlib
import html
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corvine.llm import chat, components, decontaminate, html_text, huffman, mixing, ngram_jaccard, ordinal_quality, pii, quality_rules, queries, substring_dedup, token_files
from corvine.llm.wordhash import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, anchor int, bucket string"


def make_rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 7)))
    prose = lambda n: [word() for _ in range(n)]
    shared, base = prose(60), prose(200)
    texts = [None, "", " \t\n", "one", "a b c", " ".join(base), " ".join(base), " ".join(base[:100] + ["x"] + base[100:]), "\n".join(base).upper()]
    texts += [" ".join(prose(50) + shared + prose(r.randint(1, 80))) for _ in range(6)]
    texts += [" ".join(prose(3000)) + "  " + " ".join(shared[:34]), " ".join(shared[:40]), "loop " * 300, "mail a.b@c.de, 1.2.3.4 and 4111 1111 1111 1111 or +49 30 123456789; IBAN DE89 3704 0044 0532 0130 00 <|endoftext|> x"]
    texts += [" ".join(prose(40)) for _ in range(8)]
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "c"][i % 4], 1, "clash", 3, "y") for i, t in enumerate(texts)]
    return [*rows, (None, "no id " * 5, None, "a", 1, "", 0, ""), (None, None, None, None, None, None, None, None), rows[5], rows[12]]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def grouped(rows):
    return Counter(map(tuple, rows))


def test_substring_dedup(docs):
    starts = Counter()
    split = [(i, WORD.findall(t or "")) for i, t, *_ in ROWS]
    for _, w in split:
        starts.update(tuple(w[j : j + 35]) for j in range(len(w) - 34))
    want = []
    for i, w in split:
        gone = {q for j in range(len(w) - 34) if starts[tuple(w[j : j + 35])] > 1 for q in range(j, j + 35)}
        want.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    assert grouped(substring_dedup.remove_repeats(docs).collect()) == grouped(want) and sum(w[2] for w in want) > 500


def test_like_shaped_words(spark):
    """Words, and runs of words, of opposite Thue-Morse sequences differ, though polynomials modulo 2**64 can't tell them apart."""
    signs = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[s ^ f] for s in signs) for f in (0, 1))
    tail = [f"t{i}" for i in range(34)]
    rows = [(1, " ".join([a, *tail])), (2, " ".join([b, *tail])), (3, f"{a} x"), (4, f"{b} x"), (5, " ".join("ab"[s] for s in signs[:512])), (6, " ".join("ba"[s] for s in signs[:512]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert removed[1] == removed[2] == removed[3] == removed[4] == 0
    starts = Counter(tuple(t.split()[j : j + 35]) for _, t in rows[4:] for j in range(512 - 34))
    gone = [len({q for j in range(512 - 34) if starts[tuple(t.split()[j : j + 35])] > 1 for q in range(j, j + 35)}) for _, t in rows[4:]]
    assert [removed[5], removed[6]] == gone
    links = {r.doc_id: (r.component_id, r.class_id) for r in ngram_jaccard.near_duplicates(docs, n=3).collect()}
    assert links[3] == (3, 3) and links[4] == (4, 4) and links[2][1] == 2


def test_ngram_jaccard(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t, *_ in ROWS:
        w = WORD.findall((t or "").translate(low))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    root = list(range(len(sets)))
    for _ in sets:
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets):
                if x and 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    ids = {g: min((i for (i, _), h in zip(sets, root, strict=True) if h == g and i is not None), default=None) for g in root}
    want = [(i, len(s), ids[g] if s else i) for (i, s), g in zip(sets, root, strict=True)]
    assert grouped(ngram_jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()) == grouped(want)


def test_ngram_jaccard_near_the_threshold(spark):
    """Families of sets around a similarity of 0.8, where bounds from pivots decide."""
    r = random.Random(7)
    texts = []
    for c in range(60):
        base, pool = [f"w{c}_{i}" for i in range(r.randint(8, 40))], [f"x{c % 7}_{i}" for i in range(12)]
        rate = r.choice([0.03, 0.06, 0.1, 0.15])
        for _ in range(r.choice([2, 5, 20, 60])):
            t = [w if r.random() > rate else r.choice(pool) for w in base]
            texts.append(" ".join(t[: r.randint(len(t) * 3 // 4, len(t))] if r.random() < 0.3 else t))
    sets = [frozenset(t.split()) for t in texts]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 80 * len(x | y):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    got = ngram_jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=1)
    assert {x.doc_id: x.component_id for x in got.collect()} == {i: top(i) for i in range(len(sets))}


def test_shingle_counts_hold_a_block_once():
    texts = [" ".join(f"{d % 40}w{i}" for i in range(500)) for d in range(400)]
    batches = [pa.record_batch([pa.array(texts[i : i + 4])], names=["text"]) for i in range(0, len(texts), 4)]
    block = 496 * 300
    expected = [Counter(t for text in texts[i : i + 300] for t in ngram_jaccard.shingle_sets(Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])), 5)[1].tolist()) for i in (0, 300)]
    tracemalloc.start()
    got = list(ngram_jaccard._count_shingles(5, block)(iter(batches)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [dict(zip(g.column(0).to_numpy().view(np.uint64).tolist(), g.column(1).to_pylist(), strict=True)) for g in got] == [{t: n for t, n in e.items() if n > 1} for e in expected]
    assert most < 3 * 8 * block  # the block, its copy while the pieces are joined, and what else is small


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {x: x for p in links for x in p}
    for _ in range(70):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: g for x, g in root.items() if any(x in p and p[0] != p[1] for p in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pii(docs):
    rows = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_pii(docs).collect()}
    text = ROWS[18][1]
    got = {text[a:b] for _, a, b in rows[18]}
    assert {"a.b@c.de", "1.2.3.4", "4111 1111 1111 1111", "+49 30 123456789", "DE89 3704 0044 0532 0130 00"} <= got
    assert len(rows) == len({i for i, *_ in ROWS}) and rows[0] == []


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    """Spans of the base kinds, by the patterns as stated and plain code."""
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = [int(x) for x in m[0] if x.isdigit()]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii_against_plain_code(spark, tmp_path):
    r = random.Random(6)
    texts = [t for _, t, *_ in ROWS] + ["", "٣٤٥ +٣", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "+1 +49 30 1234567 89", "😀 4111-1111-1111-1111 é@b.de x@é.de", "255.255.255.255 256.1.1.1 00255.1.1.1", "12345678901234567890123"]
    for pool, n in (("019.", 400), ("ab@.-", 400), ("0147 -", 600), ("+0123 ().-", 600), ("a1@.+ -é😀", 400)):
        texts += ["".join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(n)]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in pii.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    found = 0
    for i, t in enumerate(texts):
        want = plain_spans(t or "")
        found += len(want)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[i].spans)
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(x.startswith(k + ":") for x in want) for k in PLAIN]
        base = [x for x in got[i].spans.split(",") if x and x.split(":")[0] in PLAIN]
        assert base == want and got[i].n_spans == len([x for x in got[i].spans.split(",") if x])
    assert found > 300


def test_pii_secrets(spark):
    r = random.Random(9)
    hexes = "".join(r.choice("0123456789abcdef") for _ in range(40))
    private = {"secret": [f'api token = "{hexes}" and', f"Authorization: Bearer {hexes}", f"TOKEN = {hexes.upper()}!!"], "key": ["id AKIA" + "Q7" * 8 + ".", "ghp_" + "a1B2" * 9, "xoxb-1234567890-abcdef", "-----BEGIN RSA PRIVATE KEY-----"]}
    private |= {"password": ["password: hunter22", "pwd='s3cret-word'", "API_KEY=abc123def"], "ssn": ["social security 123-45-6789"], "iban": ["IBAN DE89 3704 0044 0532 0130 00"]}
    clean = ["a token of thanks", f"commit {hexes} fixed it", "the secret: nobody knows", "password reset", "pages 123-45-6789", "internationalization-of-everything key", "2024-01-02 key figures"]
    rows = [(i, t) for i, t in enumerate([t for ts in private.values() for t in ts] + clean)]
    got = {x.doc_id: [s.kind for s in x.spans] for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kinds = [k for k, ts in private.items() for _ in ts]
    for i, text in rows:
        assert (kinds[i] in got[i] if i < len(kinds) else not got[i]), (text, got[i])


def test_pii_long_runs(spark):
    text = "1" * 50_000 + " " + "a" * 50_000 + "@" + " 1.2.3.4" * 300
    spans = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert [text[s.start : s.end] for s in spans] == ["1.2.3.4"] * 300


def compared(got, module, tables):
    """The rows of a query equal those of its SQL over the same tables."""
    c = duckdb.connect()
    for t, place in tables.items():
        c.execute(f"CREATE TABLE {t} AS SELECT * FROM '{place}/*.parquet'")
    columns = sorted(got.columns)
    assert grouped(got.select(columns).collect()) == grouped(c.sql(module.SQL).select(*columns).fetchall())


@pytest.mark.parametrize("module", [quality_rules, decontaminate, mixing, substring_dedup, ngram_jaccard], ids=lambda m: m.__name__.split(".")[-1])
def test_sql(spark, docs, tmp_path, module):
    """The query over edge cases equals its SQL."""
    bench = [(1, " ".join(WORD.findall(ROWS[5][1])[20:60])), (2, "one"), (2, "one"), (3, None), (None, " ".join(WORD.findall(ROWS[9][1])[50:62])), (4, "a b c")]
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(5, 1, 0), (5, 0, 0), (9999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    compared(module.query(spark, str(tmp_path)), module, {t: f"{tmp_path}/{t}.parquet" for t in ("documents", "benchmark", "labels")})


def least_rejected(n, risk, level):
    """The greatest k with P(X <= k) at most ``level``, X binomial of n and ``risk``; -1 without one."""
    total, k = 0.0, -1
    while (total := total + math.comb(n, k + 1) * risk ** (k + 1) * (1 - risk) ** (n - k - 1)) <= level:
        k += 1
    return k


def test_cutoffs_at_their_bounds(spark, tmp_path):
    """Each stratum stands on one side of a boundary: as many rejected as the bound allows, and one more."""
    n, level = 900, quality_rules.DELTA / (len(quality_rules.RULES) * 4)
    most = least_rejected(n, quality_rules.RISK / len(quality_rules.RULES), level)
    assert 0 <= most < n
    r = random.Random(8)
    rows, labels = [], []

    def add(lang, symbols, good=True):
        letters = ["".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(25)]
        text = " ".join(letters)
        for at in range(symbols):
            text = text[: 9 * at] + "#" + text[9 * at + 1 :] if at < 25 else text.replace(" ", "# ", 1)
        rows.append((len(rows), text, lang, len(rows) % 3, "extra"))
        if good is not None:
            labels.append((len(rows) - 1, int(good), 0))

    # 11 of 200 characters lie between the cutoffs 0.05 and 0.06
    for lang, over in (("at", most), ("above", most + 1)):
        for i in range(n):
            add(lang, 11 if i < over else 0)
    for i in range(least_needed(level) - 1):
        add("few", 0)
    for i in range(least_needed(level)):
        add(None, 0)
    for lang in ("at", "above", "few", None):
        for symbols in (0, 6, 7, 11, 12, 13):
            add(lang, symbols, None)
        add(lang, 13, False)
    rows.append((10**6, "short", "at", 0, ""))
    schema = "doc_id long, text string, lang string, k int, stratum string"
    docs, marks = spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chosen = {(c.stratum, c.rule): c.cutoff for c in quality_rules.cutoffs(quality_rules.keep(quality_rules.measures(docs)), marks).collect()}
    assert chosen["=at", "symbols"] == 0.03 and chosen["=above", "symbols"] == 0.06 and chosen["null", "symbols"] == 0.03
    assert not any(stratum == "=few" for stratum, _ in chosen)
    judged = {x.doc_id: x for x in quality_rules.judge(docs, marks).collect()}
    for i, text, lang, *_ in rows[:-1]:
        cutoff = {"at": 0.03, "above": 0.06, None: 0.03, "few": 9}[lang]
        share = text.count("#") / len(text.replace(" ", ""))
        assert judged[i].kept == (share <= cutoff), (i, lang, share)
    assert judged[10**6].base_failed and not judged[10**6].kept
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    marks.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    compared(quality_rules.query(spark, str(tmp_path)), quality_rules, {t: f"{tmp_path}/{t}.parquet" for t in ("documents", "labels")})


def least_needed(level):
    """Good documents that a stratum needs for any cutoff: none of them rejected."""
    return math.ceil(math.log(level) / math.log(1 - quality_rules.RISK / len(quality_rules.RULES)))


def test_mixed_rows(docs):
    taken = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert mixing.mixed(docs).columns == docs.columns and max(taken.values()) <= 6  # a repeated row is taken with its copy


def test_mixing_odds(spark):
    """Greater odds are taken more often, and sources still reach their targets."""
    rows = [(i, f"w{i} " * (i % 3 + 1), "ab"[i % 2], 20.0 if i % 5 == 0 else 1.0) for i in range(2000)]
    measured = mixing.keep(mixing.measured(spark.createDataFrame(rows, "doc_id long, text string, source string, odds double"), odds="odds"))
    got = mixing.copies(measured, mixing.decisions(measured)).collect()
    for src in {r.src for r in got}:
        mine = [r for r in got if r.src == src]
        mean = {o: np.mean([r.copies for r in mine if r.odds == o]) for o in (1.0, 20.0)}
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= 3 and mean[20.0] > mean[1.0] + 0.1


def library(special_as_text=False):
    """The plain library, called on one text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = special_as_text
    return lambda t: plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("special_as_text", [False, True])
def test_token_files(docs, tmp_path, special_as_text):
    token_files.write(docs, str(tmp_path / "t"), block_ids=500, every=7, special_as_text=special_as_text)
    got = token_files.read(docs.sparkSession, str(tmp_path / "t"), every=7).orderBy("start").collect()
    ids = library(special_as_text)
    assert Counter((r.doc_id, r.ids) for r in got) == Counter((i, np.array([*ids(t or ""), 2], "<u4").tobytes()) for i, t, *_ in ROWS)
    assert any(50256 in np.frombuffer(r.ids, "<u4") for r in got) != special_as_text
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)


def test_token_parts(spark, tmp_path):
    """Rows of one doc_id, and copies, may lie in several parts; starts and ids stay right."""
    rows = [(7, f"text {i % 50}") for i in range(400)] + [(None, "copy")] * 300
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), block_ids=20)
    assert spark.read.parquet(str(tmp_path / "t/blocks")).select("part").distinct().count() > 2
    got = token_files.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    ids = library()
    assert Counter((r.doc_id, r.ids) for r in got) == Counter((i, np.array([*ids(t), 2], "<u4").tobytes()) for i, t in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist() and [r.doc_id for r in got] == [None] * 300 + [7] * 400


def test_unit_memory(monkeypatch):
    plain, tokenizer = library(), token_files.Tokenizer(token_files.tokenizer_path())
    texts = ["a b\nc", "a  b", "\n", "", " x", "x ", "it's\tI'll\n\n 3", "naïve  x", "a\r\nb", "a\u2003\u2003b \u2003c", "'s 's''s", "<|endoftext|> x<|endoftext|>", "\x1c a\x1f b", "\t\t", "a\x85\nb \x85 c", "  x \u3000", "\nfoo\n \nbar  ", "\xa0 \xa0"]
    for memory in (1 << 20, 4, 16):
        monkeypatch.setattr(token_files, "MEMORY", memory)
        for _ in range(2):
            assert [x.tolist() for x in tokenizer.encode(texts)] == [plain(t) for t in texts] and len(tokenizer.known) <= memory
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["a", "bc", "é", "9", "'s", "!", " ", " ", "\n", "\t", "\r", "\xa0", "\x1c", "\u2028", "<|endoftext|>"]) for _ in range(12))
        assert tokenizer.encode([text])[0].tolist() == plain(text), text


@pytest.mark.parametrize("counts", [[5], [1, 1], [0, 3, 0], [1] * 1000, [2**i for i in range(30)], [0, 0]])
def test_huffman(counts):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, 12)
    used = lengths[counts > 0].astype(int)
    assert (lengths[counts == 0] == 0).all() and used.max(initial=0) <= 12 and (2.0**-used).sum() <= 1
    ids = np.repeat(np.flatnonzero(counts), 9)
    bits, starts = huffman.encode(ids, lengths, huffman.canonical(lengths), np.arange(0, len(ids), 4))
    sizes = np.full(len(starts), 4)
    if len(ids):
        sizes[-1] = len(ids) - 4 * (len(starts) - 1)
    assert (huffman.decode(bits, starts, sizes, *huffman.decode_table(lengths)) == ids).all()


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", None, "", "<\\|x<|y}\\\\>", "}>", "</\\s>", "é" * 50]
    rows = [(c, t, role, x) for c, x in enumerate(texts) for t, role in enumerate(["system", "user", "assistant"])] + [(None, 0, None, "x"), (9, 0, "assistant", "first")]
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c, x in enumerate(texts):
        said = "".join(f"{r}\n{x or ''}\n" for r in ("system", "user", "assistant"))
        assert (got[c].turns_sha256, got[c].loss_sha256, got[c].valid) == (hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest(), True)
    assert not got[9].valid and got[None].n_turns == 1
    with pytest.raises(ValueError):
        chat.Template(opening="<<")


def test_chat_query(spark, tmp_path):
    """Conversation -1, digests and lengths, ties, repeated rows and clashing columns, against SQL and plain code."""
    r = random.Random(3)
    text = lambda: None if r.random() < 0.1 else "".join(r.choice(["<|", "}>", "</s>", "[INST]", "[/INST]", "\\", "é", "a ", "\n", "<", "]"]) for _ in range(r.randint(0, 9)))
    rows = [(c, t, r.choice(["system", "user", "assistant", "tool<|", None]) if c % 3 == 0 else ["user", "assistant"][t % 2], text(), "n", t) for c in range(60) for t in range(r.randint(1, 6))]
    rows += [rows[0], rows[5], (7, None, "user", "null turn", "", 0), (7, 0, "user", "tie", "", 0), (None, 0, "user", "x", "", 0), (None, 1, "assistant", "y", "", 0)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string, valid long").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.query(spark, str(tmp_path))
    compared(got, chat, {"conversations": f"{tmp_path}/conversations.parquet"})
    first = got.where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert first.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest() and first.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (first.n_turns, first.loss_chars, first.formatted_chars, first.valid) == (2, len(said), 2 * (8 + len(said) + 3) + len("userassistant"), True)


def test_html():
    page = "<head><title>no</title></head><p>a  b<p>c &amp; d<ul><li>x<li>y<ol><li>z</ol></ul><table><tr><td>1<td>22<tr><td>333<td>4</table><div hidden>no</div><script>'</div>'</script><pre>k\n  l</pre>e<br>f <b style='display: none'>no</b>"
    assert html_text.render(page) == "a b\n\nc & d\n\n- x\n- y\n  1. z\n\n1   | 22\n333 | 4\n\nk\n  l\n\ne\nf"
    assert html_text.render("<div>" * 5000 + "deep") == "deep" and html_text.render("a < b <") == "a < b <" and html_text.render("</p><td>x") == "x"


class Tree:
    """Random pages with their text by a second renderer, which goes by the tree that the page is written from."""

    def __init__(self, seed):
        self.r = random.Random(seed)

    def word(self):
        return "".join(self.r.choice("abcde<&>é") for _ in range(self.r.randint(1, 5)))

    def tag(self, name, inner, end=True):
        name = name.upper() if self.r.random() < 0.2 else name
        given = self.r.choice(["", "", " id=x", ' title="a>b"', " data-x='<p>'"])
        return f"<{name}{given}>{inner}" + (f"</{name}>" if end else "")

    def inline(self):
        """(page, text) of a line of words."""
        words = [self.word() for _ in range(self.r.randint(1, 5))]
        parts = [html.escape(w) for w in words]
        for i in range(len(parts)):
            if self.r.random() < 0.3:
                parts[i] = self.tag(self.r.choice(["b", "span", "a"]), parts[i])
            if self.r.random() < 0.1:
                parts[i] += self.r.choice(["<!-- no > -->", "<script>'</b>'</script>", "<i hidden>no</i>", "<b style='display:none'>no</b>"])
        return self.r.choice([" ", "\n  "]).join(parts), " ".join(words)

    def items(self, depth, ordered):
        page, lines = "", []
        for i in range(self.r.randint(1, 3)):
            inner, text = self.inline()
            lines.append("  " * depth + (f"{i + 1}. " if ordered else "- ") + text)
            if depth < 2 and self.r.random() < 0.3:
                more, below = self.items(depth + 1, kind := self.r.random() < 0.5)
                inner += self.tag("ol" if kind else "ul", more)
                lines += below
            page += self.tag("li", inner, self.r.random() < 0.6)
        return page, lines

    def table(self):
        rows = [[self.inline() for _ in range(self.r.randint(1, 4))] for _ in range(self.r.randint(1, 4))]
        width = [max(len(r[i][1]) for r in rows if i < len(r)) for i in range(max(map(len, rows)))]
        page = "".join(self.tag("tr", "".join(self.tag(self.r.choice(["td", "th"]), p, self.r.random() < 0.6) for p, _ in r), self.r.random() < 0.6) for r in rows)
        return page, [" | ".join(t.ljust(w) for (_, t), w in zip(r, width, strict=False)).rstrip() for r in rows]

    def block(self, depth=0):
        """Page, and blocks of (lines, whether blank lines stand around)."""
        kind = self.r.choice(["p", "h2", "ul", "ol", "table", "div", "section", "hidden"])
        if kind in ("p", "h2"):
            page, text = self.inline()
            return self.tag(kind, page), [([text], True)]
        if kind in ("ul", "ol"):
            page, lines = self.items(0, kind == "ol")
            return self.tag(kind, page), [(lines, True)]
        if kind == "table":
            page, lines = self.table()
            return self.tag("table", page), [(lines, True)]
        if kind == "hidden":
            return f"<div hidden>{self.inline()[0]}</div><nav style='visibility: hidden'><p>no</nav>", []
        if depth > 2 or self.r.random() < 0.5:
            page, text = self.inline()
            return self.tag(kind, page), [([text], False)]
        parts = [self.block(depth + 1) for _ in range(self.r.randint(1, 3))]
        return self.tag(kind, "\n".join(p for p, _ in parts)), [b for _, bs in parts for b in bs]

    def page(self):
        parts = [self.block() for _ in range(self.r.randint(1, 6))]
        text, blank = "", True
        for lines, apart in (b for _, bs in parts for b in bs):
            text += ("" if not text else "\n\n" if apart or blank else "\n") + "\n".join(lines)
            blank = apart
        return "<!DOCTYPE html><html><head><title>no</title><body>" + "\n".join(p for p, _ in parts), text


def test_html_against_a_second_renderer():
    for seed in range(600):
        page, text = Tree(seed).page()
        assert html_text.render(page) == text, (seed, page)


def test_html_spans():
    table = "<table><tr><th colspan=2>ab<th>c<tr><td rowspan=2>1<td>2<td>3<tr><td>4<td>5</table>"
    assert html_text.render(table) == "ab |   | c\n1  | 2 | 3\n   | 4 | 5"
    assert html_text.render("<table><tr><td colspan=x>a<td rowspan=0>b<tr><td>c<td>d</table>") == "a | b\nc | d"
    wide = html_text.render("<table><tr><td>" + "x" * 500 + "<td>y<tr><td>a<td>b</table>").split("\n")
    assert wide[0] == "x" * 500 + " | y" and wide[1] == "a".ljust(html_text.PAD) + " | b"
    assert html_text.render("<table>" + "<tr><td rowspan=9999 colspan=50>x" * 3 + "</table>") == "x\nx\nx"


@pytest.mark.parametrize("page", ["<a " * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<table><tr><i><td>" + "<b>" * 50_000 + "</i>" * 50_000, "<ul>" * 20_000 + "<li>x" * 20_000, "<table><tr><td>x" * 5_000, "<table><tr><td>" + "x" * 50_000 + "<td>y" + "<tr><td>a<td>b" * 20_000, "<p><b>" * 30_000, "<svg>" * 20_000 + "<text>" * 20_000])
def test_html_linear(page):
    """Broken pages take seconds, not hours."""
    began = time.process_time()
    html_text.render(page)
    assert time.process_time() - began < 20


def test_html_tables(spark):
    """Nulls, repeated rows and clashing columns."""
    rows = [(1, "<p>a", "u", "t"), (1, "<p>a", "u", "t"), (None, None, "u", "t"), (2, "", None, "t"), (None, "x<br>y", None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, url string, text string"))
    assert grouped(got.collect()) == Counter([(1, "a"), (1, "a"), (None, ""), (2, ""), (None, "x\ny")])


def test_html_raw_end_beside_long_lower_case():
    page = "<head><TITLE>İstanbul</Title><script>'</scripted>' İ</SCRIPT ></head><body><p>İ a<xmp>b</Xmp>c"
    assert html_text.render(page) == "İ a\n\nb\nc" and html_text.render("a<script>İ") == "a"


def test_html_implied_end_of_head():
    head = "<html><head> <meta charset=utf-8><title>T</title>\n<template><div>no</div></template><noscript><img alt=no>no</noscript><style>no</style>"
    assert html_text.render(head + "<h1>A</h1><p>text") == "A\n\ntext"
    assert html_text.render(head + "\n text<p>more") == "text\n\nmore"
    assert html_text.render(head + "<img alt=seen>") == "seen" and html_text.render(head + "<body>b") == html_text.render(head + "</head>b") == "b"


def test_html_shown_forms_and_graphics():
    assert html_text.render("a<textarea name=x>\nb <i>\n c &amp; d</textarea>e") == "a b <i>\n c & d e"
    assert html_text.render("<select name=s><option>one<option selected>two</select><datalist><option>no</datalist>x") == "one two x"
    svg = "<svg><title/><style>no</style><script>no</script><title>no</title><desc>no <b>no</b></desc><defs/><path d='M 0'/><text x=1>one</text><text>two <tspan>three</tspan></text></svg>"
    assert html_text.render(f"<p>a{svg}b</p>") == "a one two three b"
    assert html_text.render("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>, then</p>") == "if x=1, then"
    assert html_text.render("<svg><foreignObject>a<br/>b<img alt=c /></foreignObject></svg>") == "a\nbc"
    assert html_text.render("<div hidden><textarea>no</textarea><svg><text>no</text></svg></div>y") == "y"


def test_html_unquoted_values():
    assert html_text.render("<a href=/it's>Shown</a> you don't see <b>") == "Shown you don't see"
    assert html_text.render("<a href = /a\"b title='x>y' alt=\"it's>\">s</a><img alt=it's><p title=a='b>t<p style=display:none>no") == "sit's\n\nt"
    assert html_text.render("<a " + "b=c" * 100_000 + " d='x") == "<a " + "b=c" * 100_000 + " d='x"


def test_classifier(spark):
    r = random.Random(2)
    words = {0: "vile nasty awful".split(), 1: "buy click spam".split(), 2: "river theory garden".split()}
    rows = [(i, " ".join(r.choice(words[i % 3] + ["the", "of", "and"]) for _ in range(40)), 1 if i % 3 == 2 else 0, 1 if i % 3 == 0 else 0) for i in range(600)]
    docs = spark.createDataFrame([x[:2] for x in rows] + [(None, None), (-1, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows if i % 2], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in ordinal_quality.classify(docs, labels).collect()}
    held = [i for i in range(0, 600, 2)]
    assert np.mean([got[i].kept == (i % 3 == 2) for i in held]) > 0.95 and len(got) == 602
    assert all(0 <= got[i].tail_2 <= got[i].tail_1 <= 1 for i in held)
    assert all(x.kept for x in ordinal_quality.classify(docs, labels.where("false")).collect())


def test_classifier_rows_are_bounded(spark, monkeypatch):
    """Also where a doc_id repeats, at most ``most`` rows reach the driver; clashing columns and null labels don't matter."""
    seen = []
    fit = ordinal_quality.fit
    monkeypatch.setattr(ordinal_quality, "fit", lambda grade, *more: seen.append(len(grade)) or fit(grade, *more))
    docs = spark.createDataFrame([(i % 3, f"word{i} text", "g", 1) for i in range(90)], "doc_id long, text string, grade string, k int")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 0, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert ordinal_quality.train(docs, labels, most=20) is not None and seen == [20]
    assert ordinal_quality.classify(docs, labels).count() == 90


def vectors(texts):
    data = [t.encode() for t in texts]
    return ordinal_quality.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


def test_classifier_words_without_punctuation():
    text, index, _ = vectors(["idiot", "(idiot,", "...", ""])
    held = [set(index[text == i].tolist()) for i in range(4)]
    assert held[0] < held[1] and len(held[1] - held[0]) == 2 and len(held[2]) == 1 and not held[0] & held[2] and not held[3]


def test_classifier_stems():
    """Whole word, first four and first six characters, each where the word is longer; characters may have several bytes."""
    text, index, _ = vectors(["word", "words", "wordless", "éàüö", "éàüöx yz", "yz éàüö"])
    held = [set(index[text == i].tolist()) for i in range(6)]
    assert [len(h) for h in held] == [1, 2, 3, 1, 3, 2]
    assert held[0] < held[1] and held[0] < held[2] and len(held[1] & held[2]) == 1 and held[3] < held[4] and held[5] < held[4]


def test_classifier_new_forms(spark):
    """Words never seen in training are judged by their stems."""
    r = random.Random(8)
    ends = ["".join(r.choice("aeinrst") for _ in range(5)) for _ in range(60)]
    says = lambda stem, some: " ".join([f"plain{r.choice(ends)}" for _ in range(30)] + [stem + r.choice(some) for _ in range(6)])
    docs = spark.createDataFrame([(i, says(["zornig", "good"][i % 2], ends[:30] if i < 200 else ends[30:])) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.tail_1 for x in ordinal_quality.classify(docs, labels).collect()}
    assert max(got[i] for i in range(200, 300, 2)) < 0.5 < min(got[i] for i in range(201, 300, 2))


def test_classifier_fit_settles():
    """No scaling of the fitted model has a lower penalised loss."""
    r = random.Random(3)
    grade = np.array([r.choice([0, 1, 2]) for _ in range(400)])
    row, index, value = vectors([" ".join([f"w{r.randrange(3000)}" for _ in range(60)] + [f"g{g}"]) for g in grade])
    m = ordinal_quality.fit(grade, row, index, value)

    def loss(scale):
        scaled = ordinal_quality.Model(m.weights * scale, m.thresholds * scale)
        c = np.hstack([np.zeros((400, 1)), scaled.below(np.bincount(row, value * scaled.weights[index], 400)), np.ones((400, 1))])
        return -np.log(c[np.arange(400), grade + 1] - c[np.arange(400), grade]).mean() + ordinal_quality.DECAY / 2 * (scaled.weights**2).sum()

    assert loss(1) < min(loss(0.98), loss(1.02))


def test_classifier_fit_holds_parts(monkeypatch):
    """Beside its input the fit holds little, however many features there are; the parts don't change the model, nor do rows of no or many features."""
    r = np.random.default_rng(4)
    sizes = np.append(r.integers(0, 2000, 4000), [0, 300_000, 0])
    grade, row = r.integers(0, 3, len(sizes)), np.repeat(np.arange(len(sizes)), sizes)
    index, value = r.integers(0, 1 << 16, len(row)).astype(np.uint16), np.full(len(row), 0.03, np.float32)
    monkeypatch.setattr(ordinal_quality, "SETTLED", 0.5)
    tracemalloc.start()
    m = ordinal_quality.fit(grade, row, index, value)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(row) > 4_000_000 and peak < 6 * len(row)
    monkeypatch.setattr(ordinal_quality, "PART", 1 << 30, raising=False)
    whole = ordinal_quality.fit(grade, row, index, value)
    assert np.any(m.weights) and np.array_equal(m.weights, whole.weights) and np.array_equal(m.thresholds, whole.thresholds)


def test_classifier_rows_come_in_pieces(spark, monkeypatch):
    """No large part of the training rows is sent to the driver at once, and how they are cut doesn't change what is fitted."""
    r = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(500)}" for _ in range(i % 90))) for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(900)], "doc_id long, quality int, toxic int")
    sent, given, collect, frame = [], [], type(docs).toArrow, type(docs)
    monkeypatch.setattr(frame, "toArrow", lambda self: sent.append(collect(self)) or sent[-1])
    monkeypatch.setattr(ordinal_quality, "fit", lambda *data: given.append(data))
    for piece in (30, 900):
        monkeypatch.setattr(ordinal_quality, "PIECE", piece, raising=False)
        ordinal_quality.train(docs, labels, most=900)
    assert max(b.num_rows for b in sent[0].to_batches()) <= 60 and sent[0].num_rows == 900
    assert len(given[0][0]) == 900 and all(map(np.array_equal, *given))


def test_empty_tables(spark, tmp_path):
    for name, schema in {"documents": SCHEMA, "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, html string", "conversations": "conv_id long, turn long, role string, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if name.startswith("op5") else 0), name


def test_crc(docs):
    row = token_files.encoded(docs.where("doc_id = 3")).first()
    ids = [*library()("one"), 2]
    assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
