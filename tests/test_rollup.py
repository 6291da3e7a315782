"""Windows from day partials against windows from the rows, and attempts of steps against a scan."""

import random

import pytest

from faultline import schemas as S
from faultline.operators import rollup, stats, triage

NOW = 1_704_100_000_000
FAILURE = "repo string, signature_hash string, signature_text string, status string, occurrence_count long, last_seen_at long"


def failures(spark, seed=1, n=600):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        k = rng.randrange(6)
        seen = rng.choice([None, NOW - rng.randrange(20 * S.DAY_MS), NOW - rng.randrange(20) * S.DAY_MS])
        rows.append((f"r{k % 2}", f"h{k}", f"t{k}{rng.choice('ab')}", rng.choice(S.STATUSES), rng.choice([None, 0, 1, 2]), seen))
    return spark.createDataFrame(rows, FAILURE)


@pytest.mark.parametrize("now", [NOW, NOW // S.DAY_MS * S.DAY_MS, NOW + 1, NOW + 5 * S.DAY_MS])
@pytest.mark.parametrize("days,closed", [(7, NOW), (1, NOW - 3 * S.DAY_MS), (12, NOW + S.DAY_MS), (365, 0)])
def test_window_from_partials(spark, now, days, closed):
    rows = failures(spark)
    day = closed // S.DAY_MS * S.DAY_MS
    early = rows.filter(f"last_seen_at < {day}")
    parts = rollup.day_partials(early.filter("occurrence_count = 1")).unionByName(
        rollup.day_partials(early.filter("NOT occurrence_count <=> 1"))
    )
    got = rollup.top_flakes(parts, rows, now, closed, days).collect()
    assert sorted(got) == sorted(stats.top_flakes(rows, now, days).collect())
    got = rollup.repo_counts(parts, rows, now, closed, days).collect()
    assert sorted(got) == sorted(stats.repo_counts(rows, now, days).collect())


def test_closed_days_are_not_read(spark):
    """Only the two edges of the window are taken from the failures."""
    rows = failures(spark)
    closed = NOW // S.DAY_MS * S.DAY_MS
    since, whole = NOW - 9 * S.DAY_MS, closed - 8 * S.DAY_MS
    edges = rows.filter(f"(last_seen_at >= {since} AND last_seen_at < {whole}) OR last_seen_at >= {closed}")
    assert 0 < edges.count() < rows.filter(f"last_seen_at >= {since}").count() / 2
    parts = rollup.day_partials(rows.filter(f"last_seen_at < {closed}"))
    assert sorted(rollup.top_flakes(parts, edges, NOW, closed, 9).collect()) == sorted(stats.top_flakes(rows, NOW, 9).collect())


RUN = "failure_id string, step string, id string, status string, created_at long, duration_ms long"


def paired(rows):
    """Attempts by walking over the rows of each key."""
    keys = {}
    for r in rows:
        keys.setdefault(r[:2], []).append(r)
    out = []
    for key, own in keys.items():
        own.sort(key=lambda r: (r[4], r[2]))
        starts = 0
        for k, (_, _, id_, status, at, ms) in enumerate(own):
            after = own[k + 1] if k + 1 < len(own) else None
            if status == "started":
                starts += 1
                if after is None:
                    out.append((*key, starts, "open", id_, None, at, None, None))
                elif after[3] == "started":
                    out.append((*key, starts, "abandoned", id_, None, at, None, None))
                else:
                    out.append((*key, starts, after[3], id_, after[2], at, after[4], after[5]))
            elif k == 0 or own[k - 1][3] != "started":
                out.append((*key, None, "unstarted", None, id_, None, at, ms))
    return out


@pytest.mark.parametrize("block", [1, 2, 7, 4096])
@pytest.mark.parametrize("keys", [1, 9])
def test_step_pairs_equal_a_scan(spark, block, keys):
    """One key in very many blocks, and several keys in one, with every border between them."""
    rng = random.Random(block * keys)
    rows = [
        (rng.choice(["a", None, "b"]) if keys > 1 else "a", f"s{rng.randrange(keys)}", f"i{k}", rng.choice(["started", "started", "ok", "error"]), rng.randrange(40), k)
        for k in range(120)
    ]
    got = triage.step_pairs(spark.createDataFrame(rows, RUN), block).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, paired(rows)))


def test_step_pairs_of_nothing(spark):
    assert triage.step_pairs(spark.createDataFrame([], RUN)).count() == 0
