"""Each stage of the pipeline against plain code, on what the stage before has kept."""

import collections
import random
import zlib

import numpy as np
import pytest
from test_operators import alnum, plain_fingerprint, within_one

import corpus_pipeline as P
from kgloom.llm import line_dedup
from kgloom.llm.common import WHITE


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    r = random.Random(12)
    abc = {"en": "abcdefghij", "de": "klmnopqrst"}
    pool = {g: ["".join(r.choice(x) for _ in range(r.randint(3, 7))) for _ in range(400)] for g, x in abc.items()}
    line = lambda g, n: " ".join(r.choice(pool[g]) for _ in range(n))
    rows, items = [], [(i, line("en", 20)) for i in range(6)]
    for i in range(60):
        g = "de" if i % 5 == 3 else "en"
        rows.append((i, "\n".join(line(g, r.choice((5, 20, 45, 90))) for _ in range(6)), g, "src", 1))
    text = lambda i: rows[i][1]
    rows += [
        (60, text(4), "en", "src", 1),
        (61, text(5).replace(text(5).split()[40], "changed"), "en", "src", 1),
        (62, items[2][1] + " " + line("en", 40), "en", "src", 1),
        (63, line("en", 200) + "\n" + items[3][1] + "\n" + line("en", 500), "en", "src", 1),
        (64, "12 34 --", "en", "src", 1),
        (65, None, "de", "src", 1),
        (66, "Ωμέγα άλφα βήτα", None, "src", 1),
        (67, text(7).split("\n")[0] + "\n" + line("en", 30), "en", "src", 1),
        (68, line("en", 35), "en", "src", 1),
        (68, line("en", 35), "en", "src", 1),
        (69, line("de", 35), "de", "src", 1),
    ]
    rows.append(rows[-1])
    sf = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), [rows]
    for _, stage in P.STAGES:
        docs = P.written(stage(spark, docs, str(sf)))
        out.append([tuple(x) for x in docs.collect()])
    whole = sorted(map(tuple, P.run(spark, str(sf)).collect()))
    return out, items, whole


def pairs(rows):
    return sorted([(x[0], x[1]) for x in rows])


def test_language(stages):
    before, after = stages[0][:2]
    assert pairs(after) == pairs([x for x in before if x[0] not in (64, 65)])


def test_lines(stages):
    before, after = stages[0][1:3]
    seen, gone = [], collections.defaultdict(set)
    for doc, t in sorted(set(pairs(before))):
        for i, x in enumerate(t.encode().lower().split(b"\n")):
            for u, w in line_dedup.units(i, x.split()) if x.split() else ():
                whole = u % (1 << line_dedup.PIECE_BITS) == 0
                if any(w == y or (whole and is_line and min(len(w), len(y)) >= 8 and within_one(w, y)) for y, is_line in seen):
                    gone[doc, t].add(u)
                seen.append((w, whole))
    want = []
    for doc, t in pairs(before):
        kept = []
        for i, x in enumerate(t.split("\n")):
            w = x.split()
            line, *of = [(u, len(p)) for u, p in line_dedup.units(i, [y.encode() for y in w])] if w else [(-1, 0)]
            if line[0] in gone[doc, t] or (of and {u for u, _ in of} <= gone[doc, t]):
                continue
            at, left = 0, [] if of else w
            for u, n in of:
                left += [] if u in gone[doc, t] else w[at : at + n]
                at += n
            kept.append(" ".join(left))
        want.append((doc, "\n".join(kept)))
    assert sum(map(len, gone.values())) > 8
    assert pairs([(d, "\n".join(x.strip(WHITE) for x in t.split("\n"))) for d, t, *_ in after]) == sorted(want)
    assert all(x[4] == len(x[1]) for x in after)


def test_near_duplicates(stages):
    before, after = stages[0][2:4]
    fp = {(d, t): plain_fingerprint(t) for d, t in pairs(before)}
    group = {f: f for f in fp.values()}
    for _ in fp:
        for a in group:
            for b in group:
                if (a ^ b).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for (d, t), f in fp.items():
        least[group[f]] = min(d, least.get(group[f], d))
    gone = {d for (d, t), f in fp.items() if d != least[group[f]]}
    assert gone and pairs(after) == sorted({p for p in pairs(before) if p[0] not in gone})


def test_benchmarks(stages):
    before, after = stages[0][3:5]
    windows = {tuple(w[i : i + 13]) for _, t in stages[1] for w in [alnum(t)] for i in range(len(w) - 12)}

    def contaminated(t):
        w = alnum(t)
        hit = {i + k for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for k in range(13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert pairs(after) == pairs([x for x in before if not contaminated(x[1])])
    assert len(before) - len(after) == 1


def test_packing_and_whole(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = stages[0][4:6]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(d, [*tok.encode(t, add_special_tokens=False).ids, 0]) for d, t in pairs(before)]
    assert sorted((x[0], x[3], x[4]) for x in after) == sorted((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
    assert len({x[5] for x in after}) == -(-sum(len(x) for _, x in ids) // 2048)
    assert [x[:5] for x in stages[2]] == sorted(x[:5] for x in after)
