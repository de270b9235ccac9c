"""Decontamination against exact containment of every item in every document."""

import random

from factloom.llm import decontaminate


def brute(docs, items):
    out = []
    for doc, text in docs:
        words = (text or "").encode().lower().split()
        for item, said in items:
            asked = (said or "").encode().lower().split()
            k = min(5, len(asked))
            if k:
                held = {tuple(asked[i:i + k]) for i in range(len(asked) - k + 1)}
                n = len(held & {tuple(words[i:i + k]) for i in range(len(words) - k + 1)})
                if n >= 0.8 * len(held) - 1e-9:
                    out.append((doc or 0, item or 0, len(held), n))
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(1)
    items = [(i, " ".join(f"w{r.randrange(200)}" for _ in range(r.choice([1, 3, 5, 9, 30, 60])))) for i in range(60)] + [(60, None), (61, ""), (None, "null item of five words"), (5, "again five"), (5, "again five")]
    docs = []
    for d in range(120):
        words = [f"w{r.randrange(200)}" for _ in range(r.randrange(400))]
        for _ in range(r.randrange(4)):
            said = (r.choice(items)[1] or "").upper().split()
            for _ in range(r.randrange(3)):
                if said:
                    said[r.randrange(len(said))] = "ZZ"
            at = r.randrange(len(words) + 1)
            words[at:at] = said
        docs.append((d, r.choice([" ", "\n"]).join(words)))
    docs += [(None, "a NULL item of five words b"), (200, None), (201, ""), (201, ""), (202, "x " * 50000 + "again five")]
    df = spark.createDataFrame([(a, b, 3) for a, b in docs], "doc_id long, text string, hits int").repartition(6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for most in (1 << 20, 900):
        got = sorted((x.doc_id or 0, x.item_id or 0, x.n_shingles, x.n_found) for x in decontaminate.contained(df, bench, pass_bytes=most).collect())
        assert got == want
        kept = decontaminate.clean(df, bench, pass_bytes=most)
        assert kept.columns == df.columns
        leaked = {d for d, *_ in want}
        assert sorted(x.doc_id or 0 for x in kept.collect()) == sorted(d or 0 for d, _ in docs if (d or 0) not in leaked)
    assert decontaminate.contained(df.where("false"), bench).count() == 0
    assert decontaminate.contained(df, bench.where("false")).count() == 0
