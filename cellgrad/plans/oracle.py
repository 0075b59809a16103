"""DuckDB SQL for the correctness oracle, written from the network's maths.

An example is one row with its features ``x``, its target ``y`` and its class
``cls``; a net is one row with the weight columns of both matrices as lists of
lists (``u1``: one list per hidden unit, ``u2``: one per output).  Layers are
dot products of lists, deltas are list transforms, and a gradient cell is the
sum over examples of one product.  Nothing here joins cell tables, so the
oracle does not share the formulation it checks.
"""

from __future__ import annotations

from cellgrad.functions.scalar import W_HO_COEF, W_XH_COEF, WEIGHT_MODULUS, WEIGHT_SCALE
from cellgrad.sources.tables import LINEITEM_FEATURES, LINEITEM_KEY, LINEITEM_TIES, RETURNFLAG_CLASS


def real(x: float) -> str:
    """A DOUBLE literal that parses to exactly the Python float."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def query(parts: list[tuple[str, str]], select: str) -> str:
    body = ",\n".join(f"{name} AS MATERIALIZED ({text})" for name, text in parts)
    return f"WITH {body}\n{select}" if parts else select


def each(values: str, var: str, expr: str) -> str:
    return f"list_transform({values}, lambda {var}: {expr})"


def logistic(e: str) -> str:
    return f"(1.0 / (1.0 + exp(-({e}))))"


# ------------------------------------------------------------- examples
EMBEDDINGS = [
    ("shape", "SELECT max(len(embedding)) AS d, max(label) + 1 AS c FROM embeddings"),
    ("ex", "SELECT vec_id + 1 AS i, " + each("embedding", "t", "CAST(t AS DOUBLE)") + " AS x, "
           + each("range(c)", "k", "CAST(k = label AS INT)::DOUBLE") + " AS y, label + 1 AS cls "
           "FROM embeddings, shape"),
]

_CLASS = "CASE l_returnflag " + " ".join(f"WHEN '{f}' THEN {k}" for f, k in RETURNFLAG_CLASS.items()) + " END"
LINEITEM_ORDER = ", ".join([*LINEITEM_KEY, *LINEITEM_TIES])
LINEITEM_WIDE = (
    f"SELECT row_number() OVER (ORDER BY {LINEITEM_ORDER}) AS id, "
    + ", ".join(f"CAST({src} AS DOUBLE) / {div} * {mul} AS {name}" for name, src, div, mul in LINEITEM_FEATURES)
    + f", {_CLASS} AS species FROM lineitem")
_NAMES = ", ".join(name for name, _, _, _ in LINEITEM_FEATURES)


def lineitem(classes: int) -> list[tuple[str, str]]:
    return [
        ("shape", f"SELECT {len(LINEITEM_FEATURES)} AS d, {classes} AS c"),
        ("wide", LINEITEM_WIDE),
        ("ex", f"SELECT id AS i, [{_NAMES}] AS x, " + each("range(c)", "k", "CAST(k = species AS INT)::DOUBLE")
               + " AS y, species + 1 AS cls FROM wide, shape"),
    ]


def cells(table: str, values: str, keys: str = "i", value: str = r6("v")) -> str:
    """One row per list element."""
    return (f"SELECT {', '.join(big(k.strip(), k.strip()) for k in keys.split(','))}, {big('j', 'j')}, {value} AS v "
            f"FROM (SELECT {keys}, generate_subscripts({values}, 1) AS j, unnest({values}) AS v FROM {table})")


# ------------------------------------------------------------------ nets
def rule(r: str, k: str, coef) -> str:
    a, b = coef
    return f"(({r} * {a} + {k} * {b}) % {WEIGHT_MODULUS})::DOUBLE / {WEIGHT_SCALE} - 1.0"


def start_net(hidden: str) -> str:
    """u1 and u2 of the deterministic start weights, for ``shape``."""
    u1 = each(f"range(1, {hidden} + 1)", "k", each("range(1, d + 1)", "r", rule("r", "k", W_XH_COEF)))
    u2 = each("range(1, c + 1)", "k", each(f"range(1, {hidden} + 1)", "r", rule("r", "k", W_HO_COEF)))
    return f"{u1} AS u1, {u2} AS u2"


def hidden_of(preset: str) -> str:
    dot = "list_dot_product(x, u)"
    return each("u1", "u", f"tanh({dot})" if preset == "tanh_softmax" else logistic(dot))


def scores_of(preset: str) -> str:
    """Output values from ``a`` and ``u2``."""
    dot = "list_dot_product(a, u)"
    if preset != "tanh_softmax":
        return each("u2", "u", logistic(dot))
    raised = each("u2", "u", dot)
    return f"list_transform([{raised}], lambda z: " + each(
        "z", "t", "exp(t - list_max(z)) / list_sum(" + each("z", "s", "exp(s - list_max(z))") + ")") + ")[1]"


def slope(v: str, preset: str) -> str:
    return f"(1.0 - {v} * {v})" if preset == "tanh_softmax" else f"({v} * (1.0 - {v}))"


def passed(net: str, preset: str = "sigmoid", extra: str = "", rows: str = "ex") -> str:
    """Each example with its hidden values ``a`` and output values ``o``."""
    return (f"SELECT *, {scores_of(preset)} AS o FROM (SELECT {extra}i, x, y, cls, u1, u2, {hidden_of(preset)} AS a "
            f"FROM {rows}, {net})")


def errors(source: str, preset: str = "sigmoid") -> str:
    """Adds the output error ``e`` and the hidden error ``b``."""
    e = each("range(1, len(o) + 1)", "k", f"2.0 * (o[k] - y[k]) * {slope('o[k]', preset)}")
    b = each("range(1, len(a) + 1)", "k",
             f"{slope('a[k]', preset)} * list_sum(" + each("range(1, len(e) + 1)", "q", "e[q] * u2[q][k]") + ")")
    return f"SELECT *, {b} AS b FROM (SELECT *, {e} AS e FROM {source})"


def summed(source: str) -> str:
    """(id, i, j, v): both gradients summed over the examples of ``source``."""
    def one(mid: int, left: str, right: str) -> str:
        return (f"SELECT {mid} AS id, r AS i, k AS j, sum({left}[r] * {right}[k]) AS v FROM ("
                f"SELECT {left}, {right}, unnest(range(1, len({left}) + 1)) AS r FROM {source}), "
                f"(SELECT unnest(range(1, max(len({right})) + 1)) AS k FROM {source}) GROUP BY r, k")
    return f"{one(0, 'x', 'b')} UNION ALL {one(1, 'a', 'e')}"


def flat_net(net: str) -> str:
    """The weights of a net as (id, i, j, v)."""
    return " UNION ALL ".join(
        f"SELECT {mid} AS id, generate_subscripts(col, 1) AS i, j, unnest(col) AS v FROM ("
        f"SELECT generate_subscripts({u}, 1) AS j, unnest({u}) AS col FROM {net})" for mid, u in ((0, "u1"), (1, "u2")))


def folded_net(weights: str) -> str:
    """A net from its weights as (id, i, j, v)."""
    cols = f"SELECT id, j, list(v ORDER BY i) AS col FROM {weights} GROUP BY id, j"
    return ("SELECT list(col ORDER BY j) FILTER (WHERE id = 0) AS u1, list(col ORDER BY j) FILTER (WHERE id = 1) AS u2 "
            f"FROM ({cols})")


def descent(steps: int, lr: float, hidden: int, preset: str = "sigmoid", mean: bool = False,
            rows_of=lambda step: "ex") -> list[tuple[str, str]]:
    """Parts up to ``versions`` (iter, id, i, j, v) and ``nets`` (iter, u1, u2);
    ``rows_of``: the examples of a step."""
    parts = [("net0", f"SELECT {start_net(str(hidden))} FROM shape"), ("flat0", flat_net("net0"))]
    for k in range(1, steps + 1):
        rate = f"({real(lr)} / (SELECT count(*) FROM pass{k}))" if mean else real(lr)
        parts += [
            (f"pass{k}", passed(f"net{k - 1}", preset, rows=rows_of(k))), (f"err{k}", errors(f"pass{k}", preset)),
            (f"sum{k}", summed(f"err{k}")),
            (f"flat{k}", f"SELECT id, i, j, f.v - {rate} * s.v AS v FROM flat{k - 1} f JOIN sum{k} s USING (id, i, j)"),
            (f"net{k}", folded_net(f"flat{k}"))]
    parts.append(("versions", " UNION ALL ".join(f"SELECT {k} AS iter, id, i, j, v FROM flat{k}" for k in range(steps + 1))))
    parts.append(("nets", " UNION ALL ".join(f"SELECT {k} AS iter, u1, u2 FROM net{k}" for k in range(steps + 1))))
    return parts


def scored(preset: str = "sigmoid", key: str = "iter") -> tuple[str, str]:
    return "scored", passed("nets", preset, f"{key}, ")


FIRST_BEST = "list_position(o, list_max(o))"
HIT_SHARE = ("SELECT iter, CAST(count(*) FILTER (WHERE o[cls] = list_max(o)) AS DOUBLE) / count(*) AS precision "
             "FROM scored GROUP BY iter HAVING count(*) FILTER (WHERE o[cls] = list_max(o)) > 0")
