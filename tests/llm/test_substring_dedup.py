from lexatlas.llm import substring_dedup as sd

from tests.llm.conftest import words


def brute(rows, size):
    big = 1 << 63
    docs = sorted(((r["doc_id"] if r["doc_id"] is not None else big, words(r["text"])) for r in rows), key=lambda d: d[0])
    first = {}
    for i, w in docs:
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def check(df, size):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 1 << 63, r["n_words"], r["n_removed"], r["kept"]) for r in sd.remove_repeats(df, size).collect())
    assert got == brute(df.collect(), size)


def test_odd_rows(odd, none):
    check(odd, 50)
    check(odd, 10)
    assert sd.remove_repeats(none).count() == 0


def test_stutter_and_overlaps(spark):
    same = "a " * 200
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(3, same), (1, same + "b"), (2, f"x y {passage} z"), (5, f"{passage} q {passage}"), (4, passage[:120]), (6, f"{passage} {same}")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 50)


def test_levels():
    assert sd.levels(50) == [(6, (0,)), (12, (-6, 0)), (24, (-18, -12, -6, 0))]
    for window in range(1, 200):
        size, _ = sd.levels(window)[0]
        places = set(range(window - size + 1))  # where a surviving window can lie within a full one
        for longer, _ in sd.levels(window)[1:]:
            sides = [{p for p in (x, x - size) if p >= 0 and p + longer <= window} for x in places]
            assert all(sides), (window, longer)
            size, places = longer, set().union(*sides)
        assert size <= window


def test_only_what_repeats_is_extended(spark, monkeypatch):
    counts = {}
    plain = sd.repeating

    def seen(rows, name):
        out = plain(rows, name)
        counts[int(name)] = (rows.count(), out.count())
        return out

    monkeypatch.setattr(sd, "repeating", seen)
    rows = []
    for i in range(60):
        own = lambda n, i=i: [f"{i}.{n}.{k}" for k in range(n)]
        shared = [f"s{i // 2}.{k}" for k in range((9, 18, 40, 80)[i // 2 % 4])]
        rows.append((i, " ".join([*own(100 + i), *shared, *own(301)])))
    check(spark.createDataFrame(rows, "doc_id long, text string"), 50)
    assert sorted(counts) == [6, 12, 24]
    assert counts[6][0] > 5 * counts[6][1] and counts[12][1] < counts[12][0] and counts[24][1] < counts[24][0]
    assert all(counts[b][0] <= 2 * counts[a][1] for a, b in ((6, 12), (12, 24)))
    # nothing survives the second level: the third isn't looked at
    counts.clear()
    check(spark.createDataFrame([r for r in rows if r[0] // 2 % 4 == 0], "doc_id long, text string"), 50)
    assert 24 not in counts
