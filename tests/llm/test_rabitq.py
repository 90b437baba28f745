import numpy as np

from skein.llm import rabitq


def brute(rows, threshold=0.95):
    clean = {}
    for k, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, np.float64)
            clean[k] = x / np.linalg.norm(x)
    links = {k: [j for j in clean if j != k and len(clean[j]) == len(clean[k]) and clean[j] @ clean[k] >= threshold] for k in clean}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((i, len(links.get(k, ())), min(ids) if ids else None))
    return sorted(out, key=str)


def test_links_and_components_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size in (1, 1, 1, 2, 5, 30, 90):
        centre = rng.standard_normal(16)
        rows += [[float(x) for x in np.float32(centre + rng.standard_normal(16) * 0.22)] for _ in range(size)]
    rows += [rows[5], rows[5], [2 * x for x in rows[9]], [], None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 0.0], [0.999, 0.01]]
    ids = rng.permutation(len(rows)).tolist()
    data = [(i, v) for i, v in zip(ids, rows)] + [(ids[3], rows[3]), (None, rows[20])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<float>, rep int")
    want = brute([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in data])
    for tile in (512, 16):
        got = rabitq.near_duplicates(frame, tile=tile).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert rabitq.near_duplicates(frame.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    x = rng.standard_normal(64)
    x /= np.linalg.norm(x)
    y = x + rng.standard_normal(64) * 0.05
    y /= np.linalg.norm(y)
    errors, bounds = [], []
    for seed in range(400):
        rotation = rabitq._rotation(np.random.default_rng(seed), 64)
        code = np.where(rotation @ x > 0, 1, -1) / 8
        f = code @ (rotation @ x)
        errors.append(code @ (rotation @ y) / f - x @ y)
        bounds.append(5 * np.sqrt((1 - f * f) / (f * f) / 63))
    assert abs(np.mean(errors)) < 4 * np.std(errors) / 20
    assert (np.abs(errors) <= bounds).all()
