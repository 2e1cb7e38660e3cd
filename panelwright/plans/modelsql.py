"""DuckDB SQL of fits and scores, as common table expressions that queries put together."""

from __future__ import annotations

from itertools import combinations

#: What ``fit.scores`` gives of a prediction ``p`` and a label ``y`` known to a tenth.
SCORES = {
    "n": "count(*)",
    "n_exact": "count(*)",
    "interval_mae": "avg(greatest(y - 0.1 - p, p - (y + 0.1), 0.0))",
    "weighted_mae": "sum(greatest(y - 0.1 - p, p - (y + 0.1), 0.0) * w) / sum(w)",
    "hit_rate": "avg(CASE WHEN p BETWEEN y - 0.1 AND y + 0.1 THEN 1.0::DOUBLE ELSE 0.0 END)",
    "exact_mae": "avg(abs(p - y))",
    "exact_rmse": "sqrt(avg((p - y) * (p - y)))",
    "within_tenth": "avg(CASE WHEN abs(p - y) <= 0.1 THEN 1.0::DOUBLE ELSE 0.0 END)",
    "regime_accuracy": "avg(CASE WHEN floor(p) = floor(y) THEN 1.0::DOUBLE ELSE 0.0 END)",
}


def scored(names: list[str] | None = None) -> str:
    return ", ".join(f"{SCORES[n]} AS {n}" for n in names or SCORES)


def rounded(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def stepwise(source: str, k: int) -> str:
    """Weighted least squares by group as tables ``a0`` to ``a<k>``: column ``p<j>`` predicts from the first ``j`` features.

    ``source`` has the group ``g``, ``tr`` (whether a row is fitted on), ``w``, ``y`` and features ``f0``, ``f1``, ... Each
    feature in turn is freed of those before it, so a step needs one slope, 0 where nothing of the feature is left.
    """
    total = lambda x: f"sum(w * {x}) FILTER (WHERE tr) OVER (PARTITION BY g)"
    centred = ", ".join(f"f{i} - {total(f'f{i}')} / {total('1.0::DOUBLE')} AS f{i}" for i in range(k))
    out = [f"a0 AS (SELECT * REPLACE ({centred}), {total('y')} / {total('1.0::DOUBLE')} AS p0 FROM {source})"]
    for j in range(k):
        slope = lambda x, e=f"f{j}": f"CASE WHEN {total(f'{e} * {e}')} > 1e-9 THEN {total(f'{x} * {e}')} / {total(f'{e} * {e}')} ELSE 0.0 END"
        freed = ", ".join(f"f{i} - {slope(f'f{i}')} * f{j} AS f{i}" for i in range(j + 1, k))
        out.append(f"a{j + 1} AS (SELECT *{f' REPLACE ({freed})' if freed else ''}, p{j} + {slope('y')} * f{j} AS p{j + 1} FROM a{j})")
    return ",\n".join(out)


def signed(source: str, k: int, tag: str = "") -> str:
    """Least squares by group with coefficients of 0 or more, as table ``best<tag>`` (``g, m, my, b``: means, mean of y, coefficients); ``k`` is 3 at most.

    Every set of used features is solved by Cramer's rule, and the feasible one of the least error is taken.
    ``source`` has ``g``, ``tr``, ``w``, ``y`` and ``f0`` to ``f<k-1>``.
    """
    names = [*(f"f{i}" for i in range(k)), "y"]
    means = ", ".join(f"sum(w * {n}) / sum(w) AS m{n}" for n in names)
    v = lambda i, j: f"v{min(i, j)}{max(i, j)}"
    sums = ", ".join(f"sum(w * ({names[i]} - m{names[i]}) * ({names[j]} - m{names[j]})) AS {v(i, j)}" for i in range(k + 1) for j in range(i, k + 1))

    def det(rows: list[list[str]]) -> str:
        if not rows:
            return "1.0::DOUBLE"
        if len(rows) == 1:
            return rows[0][0]
        parts = (f"{'-' if c % 2 else '+'} {x} * ({det([r[:c] + r[c + 1 :] for r in rows[1:]])})" for c, x in enumerate(rows[0]))
        return " ".join(parts)

    choices = []
    for size in range(k + 1):
        for used in combinations(range(k), size):
            whole = [[v(i, j) for j in used] for i in used]
            solved = {u: [[v(i, k) if j == u else v(i, j) for j in used] for i in used] for u in used}
            b = [f"({det(solved[i])}) / ({det(whole)})" if i in used else "0.0::DOUBLE" for i in range(k)]
            choices.append("[" + ", ".join(b) + "]")
    error = f"{v(k, k)} - 2 * (" + " + ".join(f"b[{i + 1}] * {v(i, k)}" for i in range(k)) + ") + " + " + ".join(f"b[{i + 1}] * b[{j + 1}] * {v(i, j)}" for i in range(k) for j in range(k))
    return f"""means{tag} AS (SELECT g, {means} FROM {source} WHERE tr GROUP BY g),
sums{tag} AS (SELECT g, {", ".join(f"any_value(m{n}) AS m{n}" for n in names)}, {sums} FROM {source} JOIN means{tag} USING (g) WHERE tr GROUP BY g),
tried{tag} AS (SELECT *, unnest([{", ".join(choices)}]) AS b FROM sums{tag}),
best{tag} AS (SELECT g, [{", ".join(f"m{n}" for n in names[:-1])}] AS m, my, b FROM tried{tag} WHERE len(list_filter(b, lambda x: x < -1e-12)) = 0
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY {error}) = 1)"""


def pooled(source: str) -> str:
    """The decreasing weighted isotonic fit by group as table ``steps`` (``g, x, v``): the least over starts of the greatest mean over ends.

    ``source`` has ``g``, ``x``, ``w`` and ``y``.
    """
    return f"""level AS (SELECT g, x, sum(w) AS sw, sum(w * y) AS sy FROM {source} GROUP BY g, x),
upto AS (SELECT g, x, row_number() OVER o AS i, sum(sw) OVER o AS cw, sum(sy) OVER o AS cy FROM level WINDOW o AS (PARTITION BY g ORDER BY x)),
span AS (SELECT a.g, a.i AS i, b.i AS j, (b.cy - coalesce(z.cy, 0)) / (b.cw - coalesce(z.cw, 0)) AS m FROM upto a JOIN upto b ON a.g = b.g AND b.i >= a.i LEFT JOIN upto z ON z.g = a.g AND z.i = a.i - 1),
high AS (SELECT c.g, c.x, s.i, max(s.m) AS m FROM upto c JOIN span s ON s.g = c.g AND s.i <= c.i AND s.j >= c.i GROUP BY ALL),
steps AS (SELECT g, x, min(m) AS v FROM high GROUP BY ALL)"""
