"""A session's fold: by hand, and a stream of several batches against the static table."""

import random

from framelake.streaming import sessions

ACTIONS = "session long, at long, action string, image long"


def rows(df):
    return sorted(map(tuple, df.select("session", "at", "action", "image", "outcome", "edits").collect()), key=str)


def test_fold_by_hand(spark):
    given = [(1, 1, "edit", 5), (1, 2, "load", 5), (1, 3, "edit", 5), (1, 4, "edit", 6), (1, 5, "save", 5), (1, 6, "load", 6), (1, 7, "save", 5), (1, 8, "save", 6), (1, 9, "close", 6), (2, 1, "save", None), (2, 2, "load", None), (2, 3, "edit", None), (None, 1, "load", 1), (None, 2, "edit", 1)]
    got = {(s, at): (outcome, edits) for s, at, _, _, outcome, edits in rows(sessions.folded(spark.createDataFrame(given, ACTIONS)))}
    assert got == {
        (1, 1): ("no_image_loaded", 0), (1, 2): ("ok", 0), (1, 3): ("ok", 1), (1, 4): ("unknown_image", 1), (1, 5): ("ok", 1), (1, 6): ("ok", 0), (1, 7): ("unknown_image", 0), (1, 8): ("ok", 0), (1, 9): ("unknown_action", 0),
        (2, 1): ("no_image_loaded", 0), (2, 2): ("ok", 0), (2, 3): ("unknown_image", 0), (None, 1): ("ok", 0), (None, 2): ("ok", 1),
    }
    assert sessions.folded(spark.createDataFrame([], ACTIONS)).count() == 0


def test_stream_equals_table(spark, tmp_path):
    r = random.Random(6)
    given = [(s, at, r.choice(["load", "edit", "edit", "save", "close"]), r.choice([1, 1, 2, None])) for at in range(12) for s in range(5)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(2):  # two files, two batches; the state goes from one to the other
        spark.createDataFrame([x for x in given if x[1] // 6 == part], ACTIONS).coalesce(1).write.mode("append").parquet(folder)
    got = sessions.run_available(spark, folder, str(tmp_path / "state"), out)
    assert rows(got) == rows(sessions.folded(spark.createDataFrame(given, ACTIONS)))
    spark.createDataFrame([(0, 100, "load", 9), (0, 101, "edit", 9)], ACTIONS).coalesce(1).write.mode("append").parquet(folder)
    assert rows(sessions.run_available(spark, folder, str(tmp_path / "state"), out))[:0] == [] and sessions.run_available(spark, folder, str(tmp_path / "state"), out).count() == len(given) + 2
