"""DuckDB oracle SQL for every key of the query catalog."""

from __future__ import annotations

from cellgrad.functions.scalar import W_HO_COEF, W_XH_COEF
from cellgrad.plans import catalog as K
from cellgrad.plans import oracle as O
from cellgrad.plans.oracle import big, cells, each, logistic, query, r6
from cellgrad.sources import files as FI
from cellgrad.sources.tables import LINEITEM_FEATURES, LINEITEM_KEY

EMB = O.EMBEDDINGS
NET0 = EMB + [("net", f"SELECT {O.start_net(str(K.H))} FROM shape")]
PASS = NET0 + [("p", O.passed("net"))]
ERR = PASS + [("q", O.errors("p"))]
GRAD = ERR + [("g", O.summed("q"))]
IDS = f"{big('id', 'id')}, {big('i', 'i')}, {big('j', 'j')}"
VERSIONS = f"SELECT {big('iter', 'iter')}, {IDS}, {r6('v')} AS v FROM versions"
PRODUCT = ("SELECT r AS i, k AS j, sum(x[r] * y[k]) AS v, avg(x[r] * y[k]) AS m FROM ("
           "SELECT x, y, cls, unnest(range(1, len(x) + 1)) AS r FROM ex), "
           "(SELECT unnest(range(1, c + 1)) AS k FROM shape) GROUP BY r, k")


def _flags(table: str, n: str) -> str:
    """One-hot cells with the marker column."""
    return (f"SELECT {big('i', 'i')}, {big('j', 'j')}, {big('CAST(j = cls AS INT)', 'v')}, "
            f"{big('CASE WHEN j = cls THEN 1 END', 'dummy')} FROM "
            f"(SELECT i, cls, unnest(range(1, {n} + 1)) AS j FROM {table})")


def _store(sizes, matrices=(0, 1)) -> list[tuple[str, str]]:
    """Start weights of several hidden sizes as (w_id, id, i, j, v)."""
    shape = {0: ("d", "w_id", W_XH_COEF), 1: ("w_id", "c", W_HO_COEF)}
    parts = []
    for m in matrices:
        rows, cols, coef = shape[m]
        grid = (f"SELECT w_id, d, c, unnest(range(1, {rows} + 1)) AS i FROM shape, "
                f"(SELECT unnest([{', '.join(map(str, sizes))}]) AS w_id)")
        parts.append(f"SELECT w_id, {m} AS id, i, j, {O.rule('i', 'j', coef)} AS v FROM ("
                     f"SELECT w_id, i, unnest(range(1, {cols} + 1)) AS j FROM ({grid}))")
    return EMB[:1] + [("store", " UNION ALL ".join(parts))]


def _models(preset: str = "sigmoid") -> list[tuple[str, str]]:
    """Every example under the nets of all hidden sizes."""
    nets = " UNION ALL ".join(f"SELECT {h} AS w_id, {O.start_net(str(h))} FROM shape" for h in K.MODEL_SIZES)
    return EMB + [("nets", nets), O.scored(preset, "w_id")]


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    key = ", ".join(LINEITEM_KEY)
    key_cols = ("l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, "
                f"{r6('CAST(l_extendedprice AS DOUBLE)')} AS l_extendedprice")
    number = lambda c: f"{r6(f'CAST({c} AS DOUBLE)')} AS {c}"
    q["scan_features"] = (f"SELECT {key_cols}, {number('l_quantity')}, {number('l_discount')}, {number('l_tax')}, "
                          f"{big(O._CLASS, 'species')} FROM lineitem")
    q["replicate_rows"] = (f'SELECT CAST(n AS BIGINT) AS "copy", '
                           f"{big('count(*)', 'n_rows')}, {r6('sum(CAST(l_quantity AS DOUBLE))')} AS sum_quantity "
                           f"FROM lineitem, range(1, {K.REPLICAS + 1}) t(n) GROUP BY n")
    wide = [("wide", O.LINEITEM_WIDE)]
    q["scale_features"] = query(wide, "SELECT " + big("id", "id") + ", "
                                + ", ".join(f"{r6(n)} AS {n}" for n in ("x1", "x2", "x3", "x4")) + " FROM wide")
    q["offset_features"] = query(wide, "SELECT " + big("id", "id") + ", " + ", ".join(
        f"{r6(f'{n} + {O.real(K.OFFSET)}')} AS {n}" for n in ("x1", "x2", "x3", "x4")) + " FROM wide")
    q["assign_ids"] = (f"SELECT {big(f'row_number() OVER (ORDER BY {key})', 'id')}, {key_cols} FROM lineitem")
    first = f"WHERE i <= {K.LIMIT - 1}"
    q["limit_examples"] = query(EMB + [("few", f"SELECT * FROM ex ORDER BY i LIMIT {K.LIMIT - 1}")], cells("few", "x"))
    q["row_limit_filter"] = query(EMB + [("few", f"SELECT * FROM ex {first}")], cells("few", "x"))
    li = O.lineitem(K.IRIS_C)
    q["wide_to_coo"] = q["pack_features"] = query(li, cells("ex", "x"))
    q["one_hot_coo"] = query(EMB, _flags("ex, shape", "c"))
    q["one_hot_coo_lineitem"] = query(li, _flags("ex", str(K.IRIS_ONE_HOT_CLASSES)))
    q["one_hot_coo_labels"] = (
        f"SELECT {big('d.doc_id', 'i')}, {big('k', 'j')}, {big('count(l.doc_id)', 'v')}, "
        f"{big('CASE WHEN count(l.doc_id) > 0 THEN 1 END', 'dummy')} FROM documents d CROSS JOIN range(1, 3) t(k) "
        "LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = k - 1 GROUP BY d.doc_id, k")
    q["one_hot_array"] = query(EMB, cells("ex", "y"))
    q["class_count"] = f"SELECT {big('max(label) + 1', 'n')} FROM embeddings"
    q["series_grid"] = query(EMB, f"SELECT {big('i', 'i')}, {big('unnest(range(1, c + 1))', 'j')} FROM ex, shape")
    q["init_weights"] = q["init_weights_array"] = query(
        _store(K.HIDDEN_SIZES), f"SELECT {big('w_id', 'w_id')}, {IDS}, {r6('v')} AS v FROM store")
    ij = f"{big('i', 'i')}, {big('j', 'j')}"
    q["coo_to_array"] = q["matmul_at"] = query(EMB + [("g", PRODUCT)], f"SELECT {ij}, {r6('v')} AS v FROM g")
    q["array_transpose"] = query(EMB + [("g", PRODUCT)],
                                 f"SELECT {big('g.j', 'i')}, {big('g.i', 'j')}, {r6('v')} AS v FROM g")
    q["matrix_avg"] = query(EMB + [("g", PRODUCT)], f"SELECT {ij}, {r6('m')} AS v FROM g")
    q["matrix_avg_by_class"] = query(
        EMB + [("g", PRODUCT.replace("GROUP BY r, k", "GROUP BY cls, r, k").replace("SELECT r AS i", "SELECT cls - 1 AS label, r AS i"))],
        f"SELECT {big('label', 'label')}, {ij}, {r6('m')} AS v FROM g")
    q["literal_weights"] = q["matmul_at"]
    zero = big("0", "iter")
    q["tag_weights"] = query(EMB + [("g", PRODUCT)], f"SELECT {zero}, {big('0', 'id')}, {ij}, {r6('v')} AS v FROM g")
    q["stack_weights"] = query(GRAD, f"SELECT {zero}, {IDS}, {r6('v')} AS v FROM g")
    q["append_models"] = f"SELECT label AS w_id, i, j, v FROM ({q['matrix_avg_by_class']})"
    q["select_model"] = f"SELECT i, j, v FROM ({q['matrix_avg_by_class']}) WHERE label = {K.CLASS_MODEL}"
    plain = each("u1", "u", "list_dot_product(x, u)")
    q["matmul"] = q["array_matmul"] = query(NET0 + [("s", f"SELECT i, {plain} AS s FROM ex, net")], cells("s", "s"))
    back = each("range(1, len(u2[1]) + 1)", "k", "list_sum(" + each("range(1, len(y) + 1)", "n", "y[n] * u2[n][k]") + ")")
    q["matmul_bt"] = query(NET0 + [("s", f"SELECT i, {back} AS s FROM ex, net")], cells("s", "s"))
    q["hadamard"] = query(EMB, cells("ex", each("x", "t", "t * t")))
    q["sigmoid"] = query(EMB, cells("ex", each("x", "t", logistic("t"))))
    q["sigmoid_layer"] = q["sql_udf_sigmoid"] = query(PASS, cells("p", "a"))
    soft = NET0 + [("p", O.passed("net", "tanh_softmax"))]
    q["tanh_layer"] = q["array_tanh_layer"] = query(soft, cells("p", "a"))
    q["softmax_layer"] = q["array_softmax"] = query(soft, cells("p", "o"))
    q["forward"] = q["predict_scores"] = q["array_forward"] = query(PASS, cells("p", "o"))
    q["loss_gradient"] = query(PASS, cells("p", each("range(1, len(o) + 1)", "k", "2.0 * (o[k] - y[k])")))
    q["delta_output"] = q["array_elementwise"] = query(ERR, cells("q", "e"))
    q["delta_hidden"] = query(ERR, cells("q", "b"))
    q["array_outer"] = query(ERR + [("o1", "SELECT i, e, generate_subscripts(a, 1) AS r, unnest(a) AS t FROM q")],
                             f"SELECT {big('i', 'i')}, {big('r', 'r')}, {big('c', 'c')}, {r6('t * w')} AS v FROM ("
                             "SELECT i, r, t, generate_subscripts(e, 1) AS c, unnest(e) AS w FROM o1)")
    q["gradient"] = query(GRAD, f"SELECT {IDS}, {r6('v')} AS v FROM g")
    moved = f"f.v - {O.real(K.LR)} * g.v"
    q["weight_update"] = q["array_weight_update"] = query(
        GRAD + [("f", O.flat_net("net"))],
        f"SELECT {IDS}, {r6(moved)} AS v FROM f JOIN g USING (id, i, j)")
    q["array_mat_mul"] = query(
        EMB + [("g", PRODUCT)], f"SELECT {big('g.j', 'i')}, {big('k', 'j')}, "
        f"{r6('sum(v * (' + O.rule('g.i', 'k', W_XH_COEF) + '))')} AS v FROM g, range(1, {K.H + 1}) t(k) GROUP BY g.j, k")

    def trained(lr=K.LR, mean=False, preset="sigmoid", steps=K.STEPS):
        return EMB + O.descent(steps, lr, K.H, preset, mean)

    run = trained()
    q["train_relational"] = query(run, VERSIONS)
    q["train_relational_tanh_softmax"] = query(trained(preset="tanh_softmax"), VERSIONS)
    q["cells_per_step"] = query(run, f"SELECT {big('iter', 'iter')}, {big('count(*)', 'count')} FROM versions GROUP BY iter")
    q["distinct_steps"] = query(run, f"SELECT DISTINCT {big('iter', 'iter')} FROM versions")
    seen = run + [O.scored()]
    q["forward_all_steps"] = query(seen, cells("scored", "o", "iter, i"))
    place = "1 + len(list_filter(o, lambda t: t > o[j]))"
    q["rank_predictions"] = query(seen, f"SELECT {big('iter', 'iter')}, {ij}, {big(place, 'rank')} FROM ("
                                        "SELECT iter, i, o, generate_subscripts(o, 1) AS j FROM scored)")
    q["rank_labels"] = query(EMB, f"SELECT {ij}, {big('CASE WHEN j = cls THEN 1 ELSE 2 END', 'rank')} FROM ("
                                  "SELECT i, cls, unnest(range(1, c + 1)) AS j FROM ex, shape)")
    per_step = f"SELECT {big('iter', 'iter')}, {r6('precision')} AS precision FROM ({O.HIT_SHARE})"
    best = f"SELECT {r6('max(precision)')} AS precision FROM ({O.HIT_SHARE})"
    q["accuracy_per_step"] = query(seen, per_step)
    q["ordered_accuracy"] = query(seen, f"SELECT {big('row_number() OVER (ORDER BY iter)', 'place')}, "
                                        f"{big('iter', 'iter')}, {r6('precision')} AS precision FROM ({O.HIT_SHARE})")
    q["best_accuracy"] = query(seen, best)
    q["train_and_score"] = query(trained(K.MEAN_LR, True) + [O.scored()], best)
    off = "list_sum(" + each("range(1, len(o) + 1)", "k", "abs(2.0 * (o[k] - y[k]))") + ")"
    q["mean_abs_error"] = query(seen, f"SELECT {big('iter', 'iter')}, {r6(f'sum({off}) / sum(len(o))')} AS error "
                                      "FROM scored GROUP BY iter")
    q["array_argmax"] = query(EMB, f"SELECT {big('i', 'i')}, {big('list_position(x, list_max(x))', 'j')} FROM ex")
    q["predict_correct"] = query(PASS, f"SELECT {big('i', 'i')}, {O.FIRST_BEST} = cls AS correct FROM p")
    counted = (f"SELECT {big('iter', 'id')}, {O.FIRST_BEST} = cls AS correct, {big('count(*)', 'count')} "
               "FROM scored GROUP BY ALL")
    array_run = trained(K.ARRAY_LR, True) + [O.scored()]
    q["correct_counts"] = query(array_run, counted)
    q["best_accuracy_array"] = query(
        array_run, f"SELECT {r6('max(share)')} AS precision FROM (SELECT avg(CAST({O.FIRST_BEST} = cls AS INT)) AS share "
        "FROM scored GROUP BY iter) WHERE share > 0")
    q["predict_models"] = query(_models(), cells("scored", "o", "w_id, i"))
    q["predict_models_tanh_softmax"] = query(_models("tanh_softmax"), cells("scored", "o", "w_id, i"))
    q["predict_models_correct"] = query(_models(), f"SELECT {big('w_id', 'w_id')}, {O.FIRST_BEST} = cls AS correct, "
                                                   f"{big('count(*)', 'count')} FROM scored GROUP BY ALL")
    q["vectors_by_value"] = query(EMB, f"SELECT {r6('sum(y[1])')} AS first, {big('count(*)', 'count')}, "
                                       f"{big('min(i)', 'least')}, bool_and(y = y) AS same FROM ex GROUP BY y")
    q["train_array"] = query(trained(K.MEAN_LR, True), VERSIONS)
    q["train_array_tanh_softmax"] = query(trained(K.ARRAY_LR, True, "tanh_softmax"), VERSIONS)
    q["init_weights_seeded"] = query(EMB[:1], f"SELECT {big('d * ' + str(K.H), 'cells')}, TRUE AS in_range, "
                                              "TRUE AS all_distinct FROM shape")

    def iris(lr=K.LR, mean=False, steps=K.STEPS):
        return li + O.descent(steps, lr, K.IRIS_H, "sigmoid", mean)

    q["train_relational_lineitem"] = query(iris(), VERSIONS)
    q["train_and_score_lineitem"] = query(iris() + [O.scored()], per_step)
    q["matmul_tiled"], q["matmul_bt_tiled"], q["matmul_at_tiled"] = q["matmul"], q["matmul_bt"], q["matmul_at"]
    q["train_tiled_lineitem"] = q["train_relational_lineitem"]

    def swept(s) -> str:
        ex = EMB[1][1] if s.limit is None else f"SELECT * FROM ({EMB[1][1]}) WHERE i < {s.limit}"
        run = EMB[:1] + [("ex", ex)] + O.descent(s.steps, s.lr, s.n_hidden)
        return f"SELECT {big(str(s.w_id), 'w_id')}, * FROM ({query(run, VERSIONS)})"

    q["train_sweep"] = " UNION ALL ".join(map(swept, K.SWEEP))
    batch = lambda step: (f"(SELECT * FROM ex WHERE (i - 1) // {K.BATCH} = {step - 1} % (SELECT "  # noqa: E731
                          f"CAST(ceil(max(i) / {K.BATCH}.0) AS BIGINT) FROM ex))")
    q["train_minibatch"] = query(EMB + O.descent(K.BATCH_STEPS, K.MEAN_LR, K.H, "sigmoid", True, batch), VERSIONS)
    numbers = [f"CAST(l_linenumber = {k} AS INT)::DOUBLE" for k in range(1, K.LINE_NUMBERS + 1)]
    wide8 = (f"SELECT row_number() OVER (ORDER BY {O.LINEITEM_ORDER}) AS i, [{', '.join(numbers)}, "
             f"CAST(l_quantity AS DOUBLE) / 50] AS x, {O._CLASS} AS species FROM lineitem")
    one_hot = each("range(c)", "k", "CAST(k = species AS INT)::DOUBLE")
    eight = [("shape", f"SELECT {K.LINE_NUMBERS + 1} AS d, {K.IRIS_C} AS c"),
             ("ex", f"SELECT i, x, {one_hot} AS y, species + 1 AS cls FROM ({wide8}), shape")]
    q["train_sparse_lineitem"] = query(eight + O.descent(2, K.LR, K.H, "sigmoid", True), VERSIONS)
    q["train_array_lineitem"] = query(iris(K.MEAN_LR, True), VERSIONS)
    q["train_array_lineitem_long"] = query(iris(K.MEAN_LR, True, K.LONG_STEPS), VERSIONS)
    named = [(c, f"CAST({src} AS DOUBLE)") for c, (_, src, _, _) in zip(FI.IRIS_COLUMNS, LINEITEM_FEATURES)]
    q["scan_csv_header"] = q["scan_csv_plain"] = (
        f"SELECT {big(O._CLASS, 'species')}, {big('count(*)', 'n_rows')}, "
        + ", ".join(f"{r6(f'sum({v})')} AS {c}, {r6(f'max({v})')} AS max_{c}" for c, v in named) + " FROM lineitem GROUP BY 1")
    q["scan_csv_wide"] = query(EMB, f"SELECT {r6('CAST(cls - 1 AS DOUBLE)')} AS label, {big('j', 'j')}, {r6('avg(v)')} AS v FROM ("
                               "SELECT cls, generate_subscripts(x, 1) AS j, unnest(x) AS v FROM ex) GROUP BY cls, j")

    def logged(name, lr, preset):
        run = EMB + O.descent(K.STEPS, lr, K.H, preset, True) + [O.scored(preset)]
        return query(run, f"SELECT '{name}' AS name, {big(str(K.H), 'atts')}, {big('0', 'row_limit')}, {r6(O.real(lr))} AS lr, "
                     f"{big('iter', 'iter')}, {r6(f'avg(CAST({O.FIRST_BEST} = cls AS INT))')} AS accuracy, "
                     f"{big('3', 'headers')}, {big('1', 'bad_lines')} FROM scored GROUP BY iter")

    q["merge_result_logs"] = (f"SELECT * FROM ({logged('cellgrad-sigmoid', K.MEAN_LR, 'sigmoid')}) UNION ALL "
                              f"SELECT * FROM ({logged('cellgrad-softmax', K.ARRAY_LR, 'tanh_softmax')})")

    def stored(s) -> str:
        scores = query(EMB + O.descent(s.steps, s.lr, s.n_hidden) + [O.scored()],
                       cells(f"(SELECT * FROM scored WHERE iter = {s.steps})", "o"))
        asked = f"{s.w_id} IN (SELECT r_regionkey FROM region WHERE r_name IN ({', '.join(map(repr, K.WANTED))}))"
        return f"SELECT {big(str(s.w_id), 'w_id')}, * FROM ({scores}) WHERE {asked}"

    q["score_wanted_models"] = " UNION ALL ".join(map(stored, K.STORED))
    q["hadamard_bucketed"], q["gradient_bucketed"] = q["hadamard"], q["gradient"]
    q["train_script"] = q["train_relational"]
    q["index_grid_sql"] = query(EMB, f"SELECT {big('i', 'i')}, {big('unnest(range(1, cls + 1))', 'j')} FROM ex")
    q["matrix_grid_sql"] = query(EMB, f"SELECT {ij}, {big('count(*)', 'examples')}, {r6('sum(x[i])')} AS total FROM ("
                                 "SELECT i, x, unnest(range(1, cls + 1)) AS j FROM ("
                                 "SELECT generate_subscripts(x, 1) AS i, x, cls FROM ex)) GROUP BY i, j")
    return q


ORACLE = build()
