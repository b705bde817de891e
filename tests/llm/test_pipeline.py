"""The pipeline's stages against brute force, on texts with nulls, repeats, copies and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np

import corpus_pipeline
from corvine.llm import mixing, quality_rules, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, anchor int, bucket string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make_rows():
    r = random.Random(11)
    prose = lambda n: ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(n)]
    bench, base, other = prose(30), prose(120), prose(90)
    near = [*base[:60], "changed", *base[61:]]
    texts = [(i, " ".join(prose(r.randint(60, 140)))) for i in range(40)]
    texts += [(50, " ".join(base)), (51, " ".join(base)), (52, " ".join(near)), (52, " ".join(other)), (None, " ".join(base).upper()), (53, " ".join(other)), (60, "\n".join(near)), (None, " ".join(prose(70)))]
    texts += [(70, " ".join(prose(40) + bench[5:25] + prose(40))), (71, " ".join(prose(40) + bench[5:14] + prose(40))), (None, " ".join(prose(60) + bench)), (72, " ".join(prose(50) + bench[8:18]))]
    texts += [(80, None), (81, ""), (82, " \n"), (None, None), (83, "a b c"), (84, "loop " * 300), (85, "one line of words\n" * 40), texts[3], texts[3], texts[40], texts[-1]]
    rows = [(i, t, ["en", "de", None][n % 3], ["b", "a", None, "c"][n % 4], n, f"clash{n}", n % 5, "y") for n, (i, t) in enumerate(texts)]
    return rows, [(1, " ".join(bench)), (2, None), (2, ""), (None, " ".join(bench[3:20]))]


ROWS, BENCH = make_rows()
LABELS = [(i, 1, 0) for i in range(40)] + [(50, 1, 0), (50, 0, 0), (84, 0, 0), (9999, 1, 0), (None, 1, 0), (2, None, 0)]


def tables(spark, place, rows, bench, labels):
    for name, data, schema in (("documents", rows, SCHEMA), ("benchmark", bench, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{place}/{name}.parquet")


def by_sql(sql, rows, columns):
    """``columns`` that an operator's SQL gives over the rows that a stage takes."""
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT, k VARCHAR, anchor INT, bucket VARCHAR)")
    c.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    c.executemany("INSERT INTO labels VALUES (?, ?, ?)", LABELS)
    return c.sql(sql).select(*columns).fetchall()


def brute_near(rows):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b in range(a):
                if x and 100 * len(x & sets[b]) >= 80 * len(x | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    groups = defaultdict(list)
    for i, g in enumerate(root):
        groups[g].append(i)
    return [[rows[i] for i in g] for g in groups.values()]


def brute_hit(text, items):
    words = lambda t: TERM.findall((t or "").translate(LOW))
    mine = words(text)
    for item in items:
        theirs = words(item)
        n = min(10, len(theirs))
        windows = {tuple(theirs[j : j + n]) for j in range(len(theirs) - n + 1)} if n else set()
        if any(tuple(mine[j : j + n]) in windows for j in range(len(mine) - n + 1)):
            return True
    return False


def test_stages_against_brute_force(spark, tmp_path, monkeypatch):
    tables(spark, tmp_path, ROWS, BENCH, LABELS)
    outs = []

    def seen(stage):
        def run(*given):
            out = stage(*given).cache()
            outs.append((out.columns, Counter(map(tuple, out.collect()))))
            return out

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, seen(stage)) for name, stage in corpus_pipeline.STAGES])
    last = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    (_, good), (_, single), (_, clean), (columns, mix), (named, tokens) = outs
    assert columns == SCHEMA.replace(",", "").split()[::2] and last == tokens

    judged = Counter((i, kept) for i, kept in by_sql(quality_rules.SQL, ROWS, ["doc_id", "kept"]))
    assert Counter(r[0] for r in good.elements()) == Counter({i: n for (i, kept), n in judged.items() if kept})
    assert good <= Counter(ROWS) and not {80, 81, 82, 84} & {r[0] for r in good}

    groups = brute_near(list(good.elements()))
    assert sum(single.values()) == len(groups) < sum(good.values()) and single <= good
    for g in groups:
        (stays,) = {r for r in g if r in single}
        assert (stays[0] is None, stays[0] or 0) == min((r[0] is None, r[0] or 0) for r in g)

    assert clean == Counter({r: n for r, n in single.items() if not brute_hit(r[1], [t for _, t in BENCH])}) and sum(clean.values()) < sum(single.values())

    left = list(clean.elements())
    want = Counter()
    for i, size, n in by_sql(mixing.SQL, left, ["doc_id", "size", "copies"]):
        want[i, size] += n
    assert +want == Counter({(i, n): c for (i, n), c in Counter((r[0], len(WORD.findall(r[1]))) for r in mix.elements()).items()}) and set(mix) <= set(clean)

    tokenizer = token_files.Tokenizer(token_files.tokenizer_path())
    crc = lambda t: zlib.crc32(np.array([*tokenizer.ids(t).tolist(), 2], "<u4").tobytes())
    at = [named.index(c) for c in ("doc_id", "ids_crc32")]
    assert Counter(tuple(r[a] for a in at) for r in tokens.elements()) == Counter((r[0], crc(r[1])) for r in mix.elements())


def test_empty_pipeline(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicate_rows(spark, tmp_path):
    """One row of each component stays, also where doc_ids repeat or are null."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(50))
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (7, text("c")), (7, text("c")), (None, text("c") + " x"), (None, text("d")), (None, text("d")), (9, ""), (9, ""), (None, None)]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter([(1, text("a")), (5, text("b")), (7, text("c")), (None, text("d")), (9, ""), (9, ""), (None, None)])
