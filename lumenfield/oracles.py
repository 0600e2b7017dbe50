"""DuckDB SQL for registered queries, built from shared common table expressions."""

from __future__ import annotations

#: Each entry may use those above it.
CTE = {
    "points": "SELECT vec_id AS vertex, embedding::DOUBLE[] AS x, label::DOUBLE AS y, label::VARCHAR AS subject FROM embeddings",
    "knn": """SELECT vertex, nbr, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY vertex ORDER BY dist, nbr) - 1 AS rank
        FROM (SELECT a.vertex, b.vertex AS nbr, list_distance(a.x, b.x) AS dist FROM points a, points b)) WHERE rank <= 10""",
    "knn6": "SELECT * FROM knn WHERE rank < 6",
    "edges": "SELECT a.vertex AS i, b.vertex AS j, count(*) AS isize, min(a.dist + b.dist) AS length FROM knn6 a JOIN knn6 b ON a.nbr = b.nbr AND a.vertex < b.vertex GROUP BY ALL",
    "adj": "SELECT i AS vertex, j AS nbr, length FROM edges UNION ALL SELECT j, i, length FROM edges",
    "sets": """SELECT vertex, member FROM (SELECT vertex, member, row_number() OVER (PARTITION BY vertex ORDER BY length, member) AS r
        FROM (SELECT vertex, nbr AS member, length FROM adj UNION ALL SELECT vertex, vertex, 0.0 FROM points)) WHERE r <= 6""",
    "common": "SELECT e.i, e.j, a.member FROM edges e JOIN sets a ON a.vertex = e.i JOIN sets b ON b.vertex = e.j AND b.member = a.member",
    "isz": "SELECT e.i, e.j, count(c.member) AS isize FROM edges e LEFT JOIN common c ON c.i = e.i AND c.j = e.j GROUP BY ALL",
    "n": "SELECT count(*)::DOUBLE AS n FROM points",
    "rho0": "SELECT vertex, count(*) * (SELECT n FROM n) / (SELECT count(*) FROM sets) AS rho FROM sets GROUP BY vertex",
}


def floored(raw: str, name: str) -> dict[str, str]:
    """Scaling to the number of rows with the floor of 1e-8; ``raw`` is a relation with column mass."""
    return {
        f"{name}_a": f"SELECT * EXCLUDE (mass), mass * (SELECT count(*) FROM {raw}) / (SELECT sum(mass) FROM {raw}) AS rho FROM {raw}",
        f"{name}_s": f"SELECT count(*) AS n, count_if(rho < 1e-8) AS c, coalesce(sum(1e-8 - rho) FILTER (rho < 1e-8), 0) AS added, coalesce(sum(rho - 1e-8) FILTER (rho > 1e-8), 0) AS room FROM {name}_a",
        f"{name}_b": f"""SELECT t.* EXCLUDE (rho), CASE WHEN added > 1e-10 AND c < n THEN
              CASE WHEN room > added * 1.01 THEN 1e-8 + (greatest(rho, 1e-8) - 1e-8) * ((room - added) / room) ELSE 0.7 * greatest(rho, 1e-8) + 0.3 END
            ELSE greatest(rho, 1e-8) END AS rho FROM {name}_a t, {name}_s""",
        name: f"SELECT * EXCLUDE (rho), rho * (SELECT count(*) FROM {name}_b) / (SELECT sum(rho) FROM {name}_b) AS rho FROM {name}_b",
    }


CTE |= {"mass1": "SELECT i, j, isize, isize::DOUBLE AS mass FROM isz"} | floored("mass1", "rho1")
CTE |= {"dir1": "SELECT i AS vertex, j AS nbr, rho FROM rho1 UNION ALL SELECT j, i, rho FROM rho1"}
CTE |= {
    "weights": """SELECT d.vertex, d.nbr, 1 / greatest(d.rho, 1e-10) AS conductance, 1 / greatest(d.rho, 1e-10) / sqrt(greatest(a.rho, 1e-15) * greatest(b.rho, 1e-15)) AS mass_sym
        FROM dir1 d JOIN rho0 a ON a.vertex = d.vertex JOIN rho0 b ON b.vertex = d.nbr""",
    "delta": """SELECT e.i, e.j, e.rho, (greatest(b.rho, 1e-15) * pb.y - greatest(a.rho, 1e-15) * pa.y) / greatest(e.rho, 1e-15) AS delta
        FROM rho1 e JOIN rho0 a ON a.vertex = e.i JOIN rho0 b ON b.vertex = e.j JOIN points pa ON pa.vertex = e.i JOIN points pb ON pb.vertex = e.j""",
    "tri": """SELECT a.i AS v0, a.j AS v1, b.j AS v2, count(*) AS isize FROM edges a JOIN edges b ON b.i = a.j JOIN edges c ON c.i = a.i AND c.j = b.j
        JOIN sets s0 ON s0.vertex = a.i JOIN sets s1 ON s1.vertex = a.j AND s1.member = s0.member JOIN sets s2 ON s2.vertex = b.j AND s2.member = s0.member GROUP BY ALL""",
    "dk": "SELECT vertex, max(length) AS dk FROM adj GROUP BY vertex",
    "feat": "SELECT l_suppkey::BIGINT AS vertex, [sum(l_quantity)::DOUBLE, sum(l_extendedprice)::DOUBLE, sum(l_tax)::DOUBLE, sum(l_discount)::DOUBLE] AS x FROM lineitem GROUP BY l_suppkey",
    "vals": "SELECT event_id, user_id, value::DOUBLE AS value FROM events",
    "positive": "SELECT * FROM vals WHERE value > 0",
    "sparse": "SELECT a.vertex AS i, b.vertex AS j, min(a.dist + b.dist) AS length FROM knn a JOIN knn b ON a.nbr = b.nbr AND a.vertex < b.vertex AND a.rank < 2 AND b.rank < 2 GROUP BY ALL",
    "sadj": "SELECT i AS vertex, j AS nbr FROM sparse UNION ALL SELECT j, i FROM sparse",
    "reach": "SELECT vertex, vertex AS seen FROM points UNION SELECT r.vertex, s.nbr FROM reach r JOIN sadj s ON s.vertex = r.seen",
    "comp": "SELECT vertex, min(seen) AS component FROM reach GROUP BY vertex",
}


def sql(final: str, recursive: bool = False, **extra: str) -> str:
    """The final select after the expressions that it needs, found by name."""
    import re

    every = CTE | extra
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"[A-Za-z_]\w*", text):
            if name in every and name not in need:
                need.add(name)
                visit(every[name])

    visit(final)
    parts = [f"{k} AS {'' if k == 'reach' else 'MATERIALIZED '}({v})" for k, v in every.items() if k in need]
    return f"WITH {'RECURSIVE ' if 'reach' in need or recursive else ''}{', '.join(parts)} {final}" if parts else final
