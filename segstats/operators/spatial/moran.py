"""Global Moran's I over many columns and many weight parameters at once.

Input: node values (id, c1..cp) and an edge table (param, src, dst, w).
The numerator sum_ij w_ij z_i z_j is a sum over edges, so it needs no per-node
grouping: edges are joined to the centred values on dst and on src and summed
per param in one partial + final aggregate. Weight moments s0, s1, s2 per param
come from the same edge table (s1 pairs each edge with its reverse). Column
moments (mean, sum z^2, sum z^4) are single aggregate rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.storagelevel import StorageLevel

from segstats.functions.expressions import normal_sf
from segstats.session import cut_lineage
from segstats.operators.spatial.neighbours import neighbour_products, neighbour_sums, per_id
from segstats.operators.spatial.weights import row_standardise


def _num(v) -> F.Column:
    return F.lit(None).cast("double") if v is None else F.lit(float(v))


def column_moments(values: DataFrame, cols: list[str]) -> dict:
    """n, mean, sum z^2 and sum z^4 per column in one pass, from Spark's
    mergeable central-moment aggregates (var_pop, kurtosis)."""
    row = values.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(cols) for x in (
        F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}"), F.kurtosis(c).alias(f"k{i}"),
        F.count(c).alias(f"c{i}"))]).first()
    n = row["n"]
    out = {"n": n, "mean": {}, "m2": {}, "m4": {}}
    for i, c in enumerate(cols):
        m, v, k, cnt = row[f"m{i}"], row[f"v{i}"], row[f"k{i}"], row[f"c{i}"]
        out["mean"][c] = m
        out["m2"][c] = None if v is None else v * cnt
        out["m4"][c] = None if (v is None or k is None) else (k + 3.0) * v * v * cnt
    return out


def moran(values: DataFrame, edges: DataFrame, cols: list[str], id_col: str = "id",
          by: tuple[str, ...] = ("param",), transform: str = "R", variance: str = "textbook",
          double_p: bool = False, params: DataFrame | None = None, symmetric: bool = False) -> DataFrame:
    """Moran's I per (param, column) with normal and randomisation inference.

    ``edges`` has (by..., src, dst) and optionally ``w`` (binary if absent).
    ``transform='R'`` row-standardises (islands keep a zero row and still
    count in n); ``'B'`` keeps the weights. ``variance='compat'`` reproduces
    the randomisation variance printed by the reference; ``double_p``
    doubles the two-sided p values again as the reference does for features.

    One pass: each ordered pair carries w_ij and w_ji (edge table full-outer
    joined with its reverse) and the centred value of dst; one aggregate per
    (param, src) yields the row sum, column sum, the pair's s1 share and the
    spatial lag of every column; a final aggregate per param gives s0, s1, s2
    and the numerators sum_i z_i * lag_i.

    ``symmetric=True`` (w_ij = w_ji, e.g. distance bands) avoids the edge
    self-join: the reverse standardised weight w_ji / r_j comes from a per-node
    row-sum table joined on dst.

    Output: by..., column, I, EI, z_norm, p_norm, z_rand, p_rand, pcnt_islands.
    Params present in ``params`` but without any edge get a null I.
    """
    keys = list(by)
    w = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))
    w = w.filter(F.col("w").isNotNull())
    if symmetric:
        return _moran_symmetric(values, w, cols, id_col, keys, transform, variance, double_p, params)
    if transform == "R":
        w = row_standardise(w, tuple(keys))
    # the weighted edge table is read twice (pair and reverse): keep it once
    # (memory, spilling to disk; recomputed from lineage if an executor is
    # lost) and release it after the small result is materialised
    w = w.select(*keys, "src", "dst", "w").persist(StorageLevel.MEMORY_AND_DISK)
    mom = column_moments(values, cols)
    n = mom["n"]
    live = [c for c in cols if mom["mean"][c] is not None]
    z = values.select(F.col(id_col).alias("__id"), *[(F.col(c) - F.lit(mom["mean"][c])).alias(c) for c in live])
    rev = w.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("w_rev"))
    pairs = w.join(rev, [*keys, "src", "dst"], "full_outer")
    zd = z.select(F.col("__id").alias("dst"), *[F.col(c).alias(f"d__{c}") for c in live])
    pz = pairs.join(zd, "dst", "left")
    w0, wr0 = F.coalesce(F.col("w"), F.lit(0.0)), F.coalesce(F.col("w_rev"), F.lit(0.0))
    node = pz.groupBy(*keys, "src").agg(
        F.sum("w").alias("__r"), F.sum("w_rev").alias("__c"), F.sum(F.pow(w0 + wr0, 2)).alias("__s1"),
        *[F.sum(F.col("w") * F.col(f"d__{c}")).alias(f"lag__{c}") for c in live])
    zs = z.select(F.col("__id").alias("src"), *[F.col(c).alias(f"s__{c}") for c in live])
    nz = node.join(zs, "src", "left")
    r0, c0 = F.coalesce(F.col("__r"), F.lit(0.0)), F.coalesce(F.col("__c"), F.lit(0.0))
    per = nz.groupBy(*keys).agg(
        F.sum("__r").alias("s0"), (F.lit(0.5) * F.sum("__s1")).alias("s1"), F.sum(F.pow(r0 + c0, 2)).alias("s2"),
        F.count("__r").alias("n_linked"),
        *[F.sum(F.col(f"s__{c}") * F.col(f"lag__{c}")).alias(f"num__{c}") for c in live])
    per = per.withColumn("pcnt_islands", (F.lit(float(n)) - F.col("n_linked")) / F.lit(float(n)))
    if params is not None:
        per = params.select(*keys).distinct().join(per, keys, "left").withColumn(
            "pcnt_islands", F.coalesce("pcnt_islands", F.lit(1.0)))
    # one row per (param, column); the column moments travel as literals
    j = per.select(*keys, "s0", "s1", "s2", "pcnt_islands", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"num__{c}").alias("num"),
                 _num(mom["m2"][c]).alias("m2"), _num(mom["m4"][c]).alias("m4"))
        for c in live])).alias("t")).select(*keys, "s0", "s1", "s2", "pcnt_islands", "t.*")
    out = cut_lineage(_inference(j, n, variance, double_p, keys))
    w.unpersist()
    return out


def _moran_symmetric(values, w, cols, id_col, keys, transform, variance, double_p, params):
    # the edge table feeds the row sums and the dst join: build it once
    w = w.select(*keys, "src", "dst", "w").persist(StorageLevel.MEMORY_AND_DISK)
    mom = column_moments(values, cols)
    n = mom["n"]
    live = [c for c in cols if mom["mean"][c] is not None]
    z = values.select(F.col(id_col).alias("__id"), *[(F.col(c) - F.lit(mom["mean"][c])).alias(c) for c in live])
    rs = w.groupBy(*keys, F.col("dst").alias("__node")).agg(F.sum("w").alias("rs_d"))  # = row sums by symmetry
    zd = z.select(F.col("__id").alias("dst"), *[F.col(c).alias(f"d__{c}") for c in live])
    ed = w.join(rs.withColumnRenamed("__node", "dst"), [*keys, "dst"]).join(zd, "dst", "left")
    x = F.col("w")
    node = ed.groupBy(*keys, "src").agg(
        F.sum(x).alias("rs_i"), F.sum(x * x).alias("A"), F.sum(x * x / F.col("rs_d")).alias("B"),
        F.sum(x * x / (F.col("rs_d") * F.col("rs_d"))).alias("C"), F.sum(x / F.col("rs_d")).alias("csum"),
        *[F.sum(x * F.col(f"d__{c}")).alias(f"lag__{c}") for c in live])
    out = _moran_of_nodes(node, z, mom, live, keys, transform, variance, double_p, params)
    w.unpersist()
    return out


def _moran_of_nodes(node, z, mom, live, keys, transform, variance, double_p, params):
    """Moran's I from per-node sums: rs_i = sum w, A = sum w^2, B = sum w^2 / rs_j, C = sum w^2 / rs_j^2,
    csum = sum w / rs_j and lag__<c> = sum w z_j over the neighbours j of ``src``."""
    n = mom["n"]
    zs = z.select(F.col("__id").alias("src"), *[F.col(c).alias(f"s__{c}") for c in live])
    nz = node.join(zs, "src", "left")
    ri = F.col("rs_i")
    if transform == "R":
        r, c_ = F.lit(1.0), F.col("csum")
        s1i = F.col("A") / (ri * ri) + F.lit(2.0) * F.col("B") / ri + F.col("C")
        lag = {c: F.col(f"lag__{c}") / ri for c in live}
    else:
        r, c_ = ri, ri
        s1i = F.lit(4.0) * F.col("A")
        lag = {c: F.col(f"lag__{c}") for c in live}
    per = nz.groupBy(*keys).agg(
        F.sum(r).alias("s0"), (F.lit(0.5) * F.sum(s1i)).alias("s1"), F.sum(F.pow(r + c_, 2)).alias("s2"),
        F.count(F.lit(1)).alias("n_linked"),
        *[F.sum(F.col(f"s__{c}") * lag[c]).alias(f"num__{c}") for c in live])
    per = per.withColumn("pcnt_islands", (F.lit(float(n)) - F.col("n_linked")) / F.lit(float(n)))
    if params is not None:
        per = params.select(*keys).distinct().join(per, keys, "left").withColumn(
            "pcnt_islands", F.coalesce("pcnt_islands", F.lit(1.0)))
    j = per.select(*keys, "s0", "s1", "s2", "pcnt_islands", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"num__{c}").alias("num"),
                 _num(mom["m2"][c]).alias("m2"), _num(mom["m4"][c]).alias("m4"))
        for c in live])).alias("t")).select(*keys, "s0", "s1", "s2", "pcnt_islands", "t.*")
    return cut_lineage(_inference(j, n, variance, double_p, keys))


def band_moran(values: DataFrame, bands: list[float], cols: list[str], id_col: str = "id", inverse: bool = False, transform: str = "R",
               variance: str = "textbook", double_p: bool = False) -> DataFrame:
    """Moran's I of every column under every distance band (weight 1, or 1 / distance), as ``moran`` gives
    it for ``band_family`` edges, without a table of edges: one pass of ``neighbour_sums`` finds the
    row sums, a second one sums the neighbours' values and shares."""
    mom = column_moments(values, cols)
    live = [c for c in cols if mom["mean"][c] is not None]
    z = values.select(F.col(id_col).alias("__id"), *[(F.col(c) - F.lit(mom["mean"][c])).alias(c) for c in live])
    rows = per_id(neighbour_sums(values, bands, {"w": (1, F.lit(1.0))}, id_col, inverse=inverse), "w")
    rs = F.array(*[F.max(F.when(F.col("param") == F.lit(float(b)), F.col("w"))) for b in bands])
    own = z.groupBy("__id").agg(F.count(F.lit(1)).cast("double").alias("__m"), *[F.sum(c).alias(f"__z{i}") for i, c in enumerate(live)])
    own = own.join(rows.groupBy(F.col("id").alias("__id")).agg(rs.alias("__rs")), "__id", "left")
    pts = values.select(F.col(id_col).alias("__id"), "x", "y").join(own, "__id")

    def share(power: int) -> F.Column:
        return F.transform("__rs", lambda r: F.col("__m") / F.pow(r, F.lit(float(power))))

    sums = {"rs_i": (1, F.col("__m")), "A": (2, F.col("__m")), "B": (2, share(1)), "C": (2, share(2)), "csum": (1, share(1)),
            **{f"lag__{c}": (1, F.col(f"__z{i}")) for i, c in enumerate(live)}}
    node = per_id(neighbour_sums(pts, bands, sums, "__id", inverse=inverse), *sums).withColumnRenamed("id", "src")
    params = values.sparkSession.createDataFrame([(float(b),) for b in bands], "param double")
    return _moran_of_nodes(node, z, mom, live, ["param"], transform, variance, double_p, params)


def _inference(j: DataFrame, n: int, variance: str, double_p: bool, keys: list[str]) -> DataFrame:
    nf = float(n)
    s0, s1, s2 = F.col("s0"), F.col("s1"), F.col("s2")
    ei = -1.0 / (nf - 1.0)
    dv = F.try_divide  # ANSI mode: a zero divisor (constant column, no edges) gives null, not an error
    i_val = F.when(s0 > 0, dv(F.lit(nf) / s0 * F.coalesce(F.col("num"), F.lit(0.0)), F.col("m2")))
    s02 = s0 * s0
    vn = dv(F.lit(nf * nf) * s1 - F.lit(nf) * s2 + F.lit(3.0) * s02, F.lit(nf * nf - 1.0) * s02) - F.lit(ei * ei)
    a = F.lit(nf) * (F.lit(nf * nf - 3.0 * nf + 3.0) * s1 - F.lit(nf) * s2 + F.lit(3.0) * s02)
    if variance == "compat":
        k = dv(F.col("m2") * F.col("m2"), F.col("m4"))
        b = k * (F.lit(nf * nf - nf) * s1 - F.lit(2.0 * nf) * s2 + F.lit(6.0) * s02)
        vr = dv(a - b, F.lit((nf - 1.0) ** 3) * s02)
    else:
        k = dv(F.lit(nf) * F.col("m4"), F.col("m2") * F.col("m2"))
        b = k * (F.lit(nf * nf - nf) * s1 - F.lit(2.0 * nf) * s2 + F.lit(6.0) * s02)
        vr = dv(a - b, F.lit((nf - 1.0) * (nf - 2.0) * (nf - 3.0)) * s02) - F.lit(ei * ei)
    mult = 4.0 if double_p else 2.0
    out = j.select(*keys, "column", i_val.alias("I"), F.lit(ei).alias("EI"), vn.alias("__vn"), vr.alias("__vr"),
                   "pcnt_islands")
    out = out.withColumns({
        "z_norm": dv(F.col("I") - F.col("EI"), F.sqrt("__vn")),
        "z_rand": dv(F.col("I") - F.col("EI"), F.sqrt("__vr")),
    })
    out = out.withColumns({
        "p_norm": F.lit(mult) * normal_sf(F.abs(F.col("z_norm"))),
        "p_rand": F.lit(mult) * normal_sf(F.abs(F.col("z_rand"))),
    })
    return out.select(*keys, "column", "I", "EI", "z_norm", "p_norm", "z_rand", "p_rand", "pcnt_islands")


def best_param(moran_df: DataFrame, param: str = "param", p_col: str = "p_norm", alpha: float = 0.05) -> DataFrame:
    """Per column the parameter with the largest (signed) I among p < alpha.
    ``max_by`` is a partial aggregate, so a column with many rows is not
    gathered into one task."""
    sig = moran_df.filter(F.col(p_col) < alpha)
    best = sig.groupBy("column").agg(F.max_by(F.struct(*[c for c in moran_df.columns if c != "column"]),
                                              F.struct(F.col("I"), -F.col(param))).alias("b"))
    return best.select("column", "b.*")


def significant_counts(moran_df: DataFrame, param: str = "param", p_col: str = "p_norm") -> DataFrame:
    return moran_df.groupBy(param).agg(
        F.count(F.when(F.col(p_col) < 0.05, 1)).alias("n_sig_05"),
        F.count(F.when(F.col(p_col) < 0.001, 1)).alias("n_sig_001"))


def select_columns(moran_df: DataFrame, param_value: float, i_thres: float, param: str = "param",
                   p_col: str = "p_rand", alpha: float = 0.05) -> DataFrame:
    """Columns significant at ``param_value`` with |I| >= i_thres."""
    return moran_df.filter((F.col(param) == F.lit(param_value)) & (F.col(p_col) < alpha)
                           & (F.abs(F.col("I")) >= F.lit(i_thres))).select("column", "I")


def moran_permutations(values: DataFrame, edges: DataFrame, col: str, perms: int = 999, id_col: str = "id",
                       by: tuple[str, ...] = ("param",), transform: str = "R", seed: int = 12345,
                       block: int = 128) -> DataFrame:
    """Permutation inference for Moran's I (pseudo p of the folded rank test,
    z of I against the permutation distribution and its normal p).

    Nodes are numbered once; permutation b is a keyed bijection of the numbers
    (``permuted_index``), computed by arithmetic: every node sends its centred value to the
    numbers that get it, so nothing is sorted or ranked per permutation. A number's values
    under ``block`` permutations form one array, so a block costs one shuffle of nodes x block values, two
    joins of the edges (one per end) and a partial aggregate by permutation; edges x
    perms rows are never shuffled.
    """
    keys = list(by)
    w = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))
    w = w.filter(F.col("w").isNotNull())
    if transform == "R":
        w = row_standardise(w, tuple(keys))
    mom = column_moments(values, [col])
    n, m2 = mom["n"], mom["m2"][col]
    z = numbered_nodes(values.select(F.col(id_col).alias("__id"), (F.col(col) - F.lit(mom["mean"][col])).alias("__z")))
    ends = [z.select(F.col("__id").alias(e), F.col("__no").alias(f"__{e}")) for e in ("src", "dst")]
    w = cut_lineage(w.join(ends[0], "src").join(ends[1], "dst").select(*keys, F.col("__src").alias("src"), F.col("__dst").alias("dst"), "w"))
    sums = None
    for lo in range(1, perms + 1, block):
        part = _permuted_sums(w, permuted_values(z, range(lo, min(perms, lo + block - 1) + 1), seed), keys, lo)
        part = cut_lineage(part)
        sums = part if sums is None else sums.unionByName(part)
    s0 = w.groupBy(*keys).agg(F.sum("w").alias("s0"))
    obs = w.join(z.select(F.col("__no").alias("src"), F.col("__z").alias("__zs")), "src").join(
        z.select(F.col("__no").alias("dst"), F.col("__z").alias("__zd")), "dst").groupBy(*keys).agg(
        F.sum(F.col("w") * F.col("__zs") * F.col("__zd")).alias("__obs"))
    return _permutation_inference(sums, s0, obs, n, m2, keys, col, perms)


def _permutation_inference(sums, s0, obs, n, m2, keys, col, perms):
    scale = F.lit(float(n)) / F.col("s0") / F.lit(m2)
    sims = sums.join(s0, keys).select(*keys, (scale * F.col("__num")).alias("I_sim"))
    obs_i = obs.join(s0, keys).select(*keys, (scale * F.col("__obs")).alias("I"))
    j = sims.join(obs_i, keys).groupBy(*keys).agg(
        F.first("I").alias("I"), F.count(F.when(F.col("I_sim") >= F.col("I"), 1)).alias("__larger"),
        F.avg("I_sim").alias("EI_sim"), F.stddev_samp("I_sim").alias("seI_sim"))
    larger = F.least(F.col("__larger"), F.lit(perms) - F.col("__larger"))
    out = j.select(*keys, F.lit(col).alias("column"), "I", "EI_sim", "seI_sim",
                   ((larger + 1) / F.lit(float(perms + 1))).alias("p_sim"),
                   F.try_divide(F.col("I") - F.col("EI_sim"), F.col("seI_sim")).alias("z_sim"),
                   F.lit(perms).alias("permutations"))
    return out.withColumn("p_z_sim", normal_sf(F.abs(F.col("z_sim"))))


def band_permutations(values: DataFrame, band: float, col: str, perms: int = 999, id_col: str = "id", seed: int = 12345, block: int = 128) -> DataFrame:
    """``moran_permutations`` of the row-standardised binary band without a table of edges: under each
    permutation of a block the neighbours' values are summed, and meet the point's own value over its
    number of neighbours, inside the tasks of ``neighbour_products``."""
    mom = column_moments(values, [col])
    z = numbered_nodes(values.select(F.col(id_col).alias("__id"), (F.col(col) - F.lit(mom["mean"][col])).alias("__z")))
    rows = neighbour_sums(values, [band], {}, id_col)
    rs = cut_lineage(rows.groupBy(F.col("id").alias("__id")).agg(F.sum("neighbours").cast("double").alias("__rs")))
    pts = cut_lineage(values.select(F.col(id_col).alias("__id"), "x", "y").join(z, "__id").join(rs, "__id").select("__id", "x", "y", "__no", "__z", (1.0 / F.col("__rs")).alias("__w")))
    key, sums = [F.lit(float(band)).alias("param")], None
    for lo in range(1, perms + 1, block):
        some = range(lo, min(perms, lo + block - 1) + 1)
        got = neighbour_products(pts.join(permuted_values(z.drop("__id"), some, seed), "__no"), band, "__w", "__v", len(some), "__id")
        part = cut_lineage(got.select(*key, (F.col("place") + lo).alias("perm"), F.col("total").alias("__num")))
        sums = part if sums is None else sums.unionByName(part)
    obs = neighbour_products(pts.withColumn("__v", F.array("__z")), band, "__w", "__v", 1, "__id").select(*key, F.col("total").alias("__obs"))
    s0 = neighbour_products(pts.withColumn("__v", F.array(F.lit(1.0))), band, "__w", "__v", 1, "__id").select(*key, F.col("total").alias("s0"))
    return _permutation_inference(sums, s0, obs, mom["n"], mom["m2"][col], ["param"], col, perms)


def numbered_nodes(z: DataFrame) -> DataFrame:
    """``z`` (written) with ``__no``, the numbers 0..n-1 in the order of the ids."""
    from segstats.operators.sampling import ordered_position

    return cut_lineage(ordered_position(z, ["__id"], "__no"))


ROUNDS, WALKS = 6, 64


def permuted_index(number: F.Column, key: F.Column, n: int, seed: int) -> F.Column:
    """A bijection of 0..n-1 for every ``key``: a Feistel network over pairs (left, right) with
    ``a`` and ``b`` values, a * b >= n, whose rounds add a hash of the one half to the other.
    Results from n on walk on until they fall below n; fewer than ``a`` <= sqrt(n) + 1 pairs
    lie there, so up to n = WALKS**2 no walk is longer than WALKS steps, and beyond that one would need
    WALKS hits of a share below 1 / WALKS (it is an error, never a wrong result)."""
    a = math.isqrt(max(n - 1, 0)) + 1
    b = max(1, -(-n // a))

    def shuffled(x: F.Column) -> F.Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, F.lit(b))
        for i in range(ROUNDS):
            if i % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(left, key, F.lit(seed * ROUNDS + i)), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(right, key, F.lit(seed * ROUNDS + i)), F.lit(a)), F.lit(a))
        return left * b + right

    first = shuffled(number)
    walked = F.reduce(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(x < n, x).otherwise(shuffled(x)))
    walked = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a permutation walked too long")).cast("long"))
    return F.when(first < n, first).otherwise(walked)


def permuted_values(z: DataFrame, perms: range, seed: int) -> DataFrame:
    """Array ``__v`` of the values that a node gets under each permutation of ``perms``, by
    its number ``__no`` (by its ``__id`` if ``z`` is not numbered)."""
    if "__no" not in z.columns:
        z = numbered_nodes(z)
        return z.select("__no", "__id").join(permuted_values(z.drop("__id"), perms, seed), "__no").drop("__no")
    sent = z.select("__no", "__z", F.explode(F.array(*[F.lit(p) for p in perms])).alias("perm")).select(
        permuted_index(F.col("__no"), F.col("perm"), z.count(), seed).alias("__no"), "perm", "__z")
    arrays = sent.groupBy("__no").agg(F.sort_array(F.collect_list(F.struct("perm", "__z"))).alias("__v"))
    return cut_lineage(arrays.select("__no", F.col("__v.__z").alias("__v")))


def _permuted_sums(w: DataFrame, v: DataFrame, keys: list[str], first: int) -> DataFrame:
    """(keys..., perm, __num): sum of w * z_src * z_dst for each permutation of a block."""
    both = (w.join(v.select(F.col("__no").alias("src"), F.col("__v").alias("__vs")), "src")
            .join(v.select(F.col("__no").alias("dst"), F.col("__v").alias("__vd")), "dst"))
    product = F.zip_with("__vs", "__vd", lambda a, b: a * b)
    return (both.select(*keys, "w", F.posexplode(product).alias("__i", "__p"))
            .groupBy(*keys, (F.col("__i") + first).alias("perm")).agg(F.sum(F.col("w") * F.col("__p")).alias("__num")))
