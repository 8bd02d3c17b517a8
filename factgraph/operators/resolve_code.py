"""Resolution of names, imports and types to symbols, and what becomes a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph import parts
from factgraph.functions.text import framed_digest, path_suffixes
from factgraph.scratch import Scratch


def resolve_names(uses: DataFrame, bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """(use, target, external, reason) of uses (use, file, receiver, name, local) of names and of members.

    bindings: (file, local_name, imported_name, module, external): what a file imports under a name; no
    imported_name is the module itself, ``module`` its file if it is known, ``external`` its package if it is not
    of this workspace.  symbols: (uid, file, name, qualified_name, top).  ``local`` says that the name (the receiver, if
    there is one) is also bound inside; then nothing outside is meant for sure.

    A name is what the file imports under it, else the file's one top-level symbol of it.  A member is that of an
    imported module, or of a type that the file declares once.  Several candidates are ambiguous.
    """
    order = F.struct("imported_name", "module", "external")
    first = bindings.groupBy("file", "local_name").agg(F.min(order).alias("n"), F.min(F.when(F.col("imported_name").isNull(), order)).alias("m"))
    first = first.select(F.col("file"), F.col("local_name").alias("_key"), F.col("n").alias("_n"), F.col("m").alias("_m"), F.lit(True).alias("_bound"))
    top = symbols.where("top").groupBy("file", "name").agg(F.count("*").alias("n"), F.min("uid").alias("uid"))
    inner = symbols.groupBy("file", "qualified_name").agg(F.count("*").alias("_q_n"), F.min("uid").alias("_q"))
    member = F.col("receiver").isNotNull()
    n = parts.tasks(uses, bindings, symbols)
    j = parts.join(uses.withColumn("_key", F.coalesce("receiver", "name")), first, ["file", "_key"], n, "left")
    use_import = F.when(member, F.col("_m").isNotNull()).otherwise(F.coalesce("_bound", F.lit(False)))
    j = j.withColumn("_use", use_import).withColumn("_b", F.when(member, F.col("_m")).otherwise(F.col("_n"))).withColumn("_want", F.when(member, F.col("name")).otherwise(F.col("_b.imported_name")))
    own = top.select("file", F.col("name").alias("_key"), F.col("n").alias("_own_n"), F.col("uid").alias("_own"))
    far = top.select(F.col("file").alias("_module"), F.col("name").alias("_want"), F.col("n").alias("_far_n"), F.col("uid").alias("_far"))
    j = j.withColumn("_module", F.col("_b.module")).withColumn("qualified_name", F.concat_ws(".", "receiver", "name"))
    for right, keys in ((own, ["file", "_key"]), (far, ["_module", "_want"]), (inner, ["file", "qualified_name"])):
        j = parts.join(j, right, keys, n, "left")
    none = lambda x: F.coalesce(x, F.lit(0))
    answer = lambda target, external, reason: F.struct(target.alias("target"), external.alias("external"), reason.alias("reason"))
    null = F.lit(None).cast("string")
    counted = lambda n, uid, zero: F.when(none(n) == 1, answer(uid, null, null)).when(none(n) > 1, answer(null, null, F.lit("AMBIGUOUS_CANDIDATES"))).otherwise(answer(null, null, F.lit(zero)))
    imported = (
        F.when(F.col("_b.module").isNotNull(), counted(F.col("_far_n"), F.col("_far"), "NAME_NOT_IN_MODULE"))
        .when(F.col("_b.external").isNotNull(), answer(null, F.concat_ws(":", "_b.external", "_want"), null))
        .otherwise(answer(null, null, F.lit("IMPORT_TARGET_UNRESOLVED")))
    )
    typed = answer(null, null, F.lit("RECEIVER_TYPE_REQUIRED"))
    bare = F.when(F.col("local"), answer(null, null, F.lit("POSSIBLY_SHADOWED"))).when(F.col("_use") & F.col("_want").isNull(), typed).when(F.col("_use"), imported).otherwise(counted(F.col("_own_n"), F.col("_own"), "NO_STRUCTURAL_BINDING"))
    of_type = F.when(F.col("local"), typed).when(F.col("_use"), imported).when(none(F.col("_own_n")) == 1, counted(F.col("_q_n"), F.col("_q"), "RECEIVER_TYPE_REQUIRED")).otherwise(typed)
    return j.select("use", F.when(member, of_type).otherwise(bare).alias("r")).select("use", "r.*")


#: The files that a module path may stand for.
PYTHON_EXTENSIONS = ("py", "pyi")
JS_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")


def normal_path(directory: Column, specifier: Column) -> Column:
    """``specifier`` below ``directory`` with ``.`` and ``..`` resolved; null if it climbs above the root."""
    parts = F.filter(F.concat(F.split(directory, "/"), F.split(specifier, "/")), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        up, n = x == "..", F.size(acc["at"])
        at = F.when(up, F.slice(acc["at"], F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(F.array_append(acc["at"], x))
        return F.struct(at.alias("at"), (acc["ok"] & ~(up & (n == 0))).alias("ok"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["at"], "/")))


def resolve_imports(imports: DataFrame, modules: DataFrame, crates: DataFrame) -> DataFrame:
    """(use, outcome, target, package, reason) of imports (use, path_key, language, specifier, levels).

    levels: leading dots of a relative Python import, else null.  modules: (uid, path_key); crates: (name) that a
    manifest of the workspace could give.  Outcomes: INTERNAL (one file), AMBIGUOUS, EXTERNAL, UNRESOLVED with a reason.
    """
    spec, lang = F.col("specifier"), F.col("language")
    script, rust = lang.isin("JAVASCRIPT", "TYPESCRIPT"), lang == "RUST"
    home = F.regexp_replace(F.regexp_extract("path_key", r"^(.*)/", 1), "/$", "")
    dots = F.array_join(F.filter(F.split(spec, r"\."), lambda x: x != ""), "/")
    ups = F.repeat(F.lit("../"), F.greatest(F.coalesce("levels", F.lit(1)) - 1, F.lit(0)).cast("int"))
    relative = (lang == "PYTHON") & F.col("levels").isNotNull() | script & F.startswith(spec, F.lit("."))
    base = F.when(lang == "PYTHON", normal_path(home, F.concat(ups, dots))).when(script, normal_path(home, spec))
    files = lambda exts, index: [F.concat(F.lit(f"{mid}.{e}")) for e in exts for mid in ("", f"/{index}")]
    ends = F.when(lang == "PYTHON", F.array(*files(PYTHON_EXTENSIONS, "__init__"))).otherwise(F.array(F.lit(""), *files(JS_EXTENSIONS, "index")))
    absolute = (lang == "PYTHON") & F.col("levels").isNull() & (dots != "")
    rows = imports.withColumn("_rel", F.coalesce(relative, F.lit(False))).withColumn("_abs", F.coalesce(absolute, F.lit(False))).withColumn("_base", F.when(relative, base).when(absolute, dots))
    tried = rows.where("_base IS NOT NULL").select("use", "_abs", F.explode(F.transform(ends, lambda e: F.concat("_base", e))).alias("path_key"))
    exact = tried.where("NOT _abs").join(modules, "path_key").select("use", "uid")
    suffix = modules.select("uid", F.explode(path_suffixes(F.col("path_key"))).alias("path_key"))
    hits = exact.unionByName(tried.where("_abs").join(suffix, "path_key").select("use", "uid")).groupBy("use").agg(F.count_distinct("uid").alias("_n"), F.min("uid").alias("_uid"))
    local = crates.select(F.col("name").alias("_crate"), F.lit(True).alias("_local")).distinct()
    j = rows.withColumn("_crate", F.element_at(F.split(spec, "::"), 1)).join(hits, "use", "left").join(local, "_crate", "left")
    n, first = F.coalesce("_n", F.lit(0)), F.split(spec, "/")
    scoped = F.startswith(spec, F.lit("@"))
    package = F.when(lang == "PYTHON", F.element_at(F.split(dots, "/"), 1)).when(script, package_of(spec)).when(rust, F.col("_crate"))
    reason = (
        F.when(lang == "CSHARP", "NAMESPACE_REQUIRES_SEMANTICS").when(lang == "SVELTE", "COMPOUND_SPECIFIER")
        .when(rust & F.regexp_like(spec, F.lit(r"[{*]")), "COMPOUND_SPECIFIER").when(rust & F.regexp_like(spec, F.lit(r"^(?:crate|self|super)(?:::|$)")), "MODULE_TREE_REQUIRES_SEMANTICS")
        .when(rust & (F.col("_crate") == ""), "COMPOUND_SPECIFIER").when(rust & F.col("_local"), "RUST_WORKSPACE_CRATE_REQUIRES_SEMANTICS")
        .when(F.col("_rel") & (n == 0), "MISSING_RELATIVE_TARGET")
        .when(script & ~F.col("_rel") & F.startswith(spec, F.lit("/")), "CONFIG_DEPENDENT_SPECIFIER")
        .when(script & ~F.col("_rel") & ((spec == "") | scoped & (F.size(first) < 2)), "COMPOUND_SPECIFIER")
        .when((lang == "PYTHON") & ~F.col("_rel") & ~F.col("_abs"), "COMPOUND_SPECIFIER")
    )
    outcome = F.when(reason.isNotNull(), "UNRESOLVED").when(n == 1, "INTERNAL").when(n > 1, "AMBIGUOUS").otherwise("EXTERNAL")
    return j.select("use", outcome.alias("outcome"), F.when(outcome == "INTERNAL", F.col("_uid")).alias("target"), F.when(outcome == "EXTERNAL", package).alias("package"), reason.alias("reason"))


def package_of(module: Column) -> Column:
    """The package of a bare module name; scoped names keep two parts."""
    parts = F.split(module, "/")
    return F.when(F.startswith(module, F.lit("@")), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.element_at(parts, 1))


def inheritance_kind(target_kind: Column) -> Column:
    return F.when(target_kind.isin("INTERFACE", "TRAIT"), "IMPLEMENTS").otherwise("EXTENDS")


def overrides(members: DataFrame, extends: DataFrame, depth: int = 16, opaque: DataFrame | None = None) -> DataFrame:
    """For members (uid, owner, name, kind) the nearest inherited member of the same name and kind.

    Bases are searched level by level; the first level that declares one decides: one is an edge, more
    are ambiguous.  Where none does, a member is OPAQUE if its owner, or a base of it, extends something outside
    (``opaque``: owners).  (uid, target, outcome)

    Levels are walked once an owner, and declarations are one row a base, name and kind: their least and greatest uid, which
    are equal if there is just one.  So members of one name never meet one another.
    """
    scratch = Scratch(members.sparkSession)
    up = scratch.write(extends.select(F.col("source").alias("base"), F.col("target").alias("_next")).distinct())
    owners = scratch.write(members.select("owner").distinct())
    front = scratch.write(owners.select("owner", F.col("owner").alias("base")))
    reach, above = front, None
    for level in range(1, depth + 1):
        front = front.join(up, "base").select("owner", F.col("_next").alias("base")).distinct()
        front = scratch.write(front.join(reach, ["owner", "base"], "left_anti"))
        if front.isEmpty():
            break
        reach = reach.unionByName(front)
        at = front.withColumn("_level", F.lit(level))
        above = at if above is None else above.unionByName(at)
    if above is None:
        out = members.limit(0).select("uid", F.lit(None).cast("string").alias("target"), F.lit("").alias("outcome"))
    else:
        key = ["owner", "name", "kind"]
        declared = scratch.write(members.groupBy(*key).agg(F.min("uid").alias("_low"), F.max("uid").alias("_high")))
        low, high = F.min(F.struct("_level", F.col("_low").isNull().alias("_none"), "_low")), F.max(F.struct(-F.col("_level"), "_high"))
        nearest = lambda df, by: df.groupBy(*by).agg(low.alias("_a"), high.alias("_z")).select(*by, "_a._level", "_a._low", "_z._high")
        bases = declared.select(F.col("owner").alias("base"), "name", "kind", "_low", "_high")
        hit = scratch.write(nearest(declared.select(*key).join(above, "owner").join(bases, ["base", "name", "kind"]), key))
        one = F.col("_low") == F.col("_high")
        hit = nearest(members.select("uid", *key).join(hit, key), ["uid"])
        out = hit.select("uid", F.when(one, F.col("_low")).alias("target"), F.when(one, "OVERRIDES").otherwise("AMBIGUOUS").alias("outcome"))
    if opaque is None:
        return out
    out = scratch.write(out)
    beyond = reach.join(opaque.select(F.col("owner").alias("base")).distinct(), "base", "left_semi").select("owner").distinct()
    dark = members.join(beyond, "owner", "left_semi").select("uid").distinct().join(out.select("uid"), "uid", "left_anti")
    return out.unionByName(dark.select("uid", F.lit(None).cast("string").alias("target"), F.lit("OPAQUE").alias("outcome")))


def implements(members: DataFrame, owners: DataFrame, bases: DataFrame, depth: int = 16) -> DataFrame:
    """(uid, target, outcome): the interface member that each member (uid, owner, name, kind, explicit) implements.

    owners: (owner, name, interface boolean); bases: (source, target), by extension and implementation alike.  A
    member that names an interface (``explicit``) implements that one alone, and takes its name there from
    members of the type that name none.  One declaration is an edge, several are ambiguous.
    """
    scratch = Scratch(members.sparkSession)
    up = scratch.write(bases.select(F.col("source").alias("owner"), F.col("target").alias("base")).distinct())
    front = reach = scratch.write(members.select("owner", F.col("owner").alias("base")).distinct())
    for _ in range(depth):
        front = front.join(up.withColumnRenamed("owner", "_o").withColumnRenamed("base", "_b"), F.col("base") == F.col("_o")).select("owner", F.col("_b").alias("base")).distinct()
        front = scratch.write(front.join(reach, ["owner", "base"], "left_anti"))
        if front.isEmpty():
            break
        reach = reach.unionByName(front)
    above = reach.where("owner <> base").join(owners.where("interface").select(F.col("owner").alias("base"), F.col("name").alias("_interface")), "base")
    there = members.select(F.col("owner").alias("base"), "name", "kind", F.col("uid").alias("target"))
    claimed = members.where("explicit IS NOT NULL").select("owner", F.col("explicit").alias("_interface"), "name", F.lit(True).alias("_claimed")).distinct()
    hit = members.join(owners.where("NOT interface").select("owner"), "owner", "left_semi").join(above, "owner").join(there, ["base", "name", "kind"]).join(claimed, ["owner", "_interface", "name"], "left")
    hit = hit.where(F.when(F.col("explicit").isNotNull(), F.col("explicit") == F.col("_interface")).otherwise(F.col("_claimed").isNull()))
    n = hit.groupBy("uid").agg(F.count_distinct("target").alias("n"), F.min("target").alias("t"))
    return n.select("uid", F.when(F.col("n") == 1, F.col("t")).alias("target"), F.when(F.col("n") == 1, "IMPLEMENTS").otherwise("AMBIGUOUS").alias("outcome"))


#: The fields that make a logical symbol, in the order of their digest; paths are none of them.
IDENTITY = ("context", "project", "qualified_name", "kind", "arity", "discriminator")


def logical_symbols(symbols: DataFrame) -> DataFrame:
    """(identity, declarations, first): declarations (uid and the fields of ``IDENTITY``) of one symbol are one row."""
    s = symbols.withColumn("identity", framed_digest(*[F.col(c) for c in IDENTITY]))
    return s.groupBy("identity").agg(F.count("*").alias("declarations"), F.min("uid").alias("first"))


#: What an outcome without a target becomes as a gap.
GAPS = {"AMBIGUOUS": "AMBIGUOUS_CANDIDATES", "NOT_FOUND": "NO_STRUCTURAL_BINDING", "DYNAMIC": "DYNAMIC_KEY_EXPRESSION", "CONFIG": "CONFIG_DEPENDENT_SPECIFIER", "SHADOWED": "POSSIBLY_SHADOWED", "MACRO": "MACRO_CALL_REQUIRES_SEMANTICS", "TYPE": "TYPE_SEMANTICS_REQUIRED"}


def gap_reason(outcome: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, reason in GAPS.items():
        out = F.when(outcome == name, reason).otherwise(out)
    return out


def merge_evidence(sites: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim, outcome) of semantic claims that meet the sites of their owner.

    claims: (claim, site, resolved, kind, source, target); sites: (site, revision, current, bound_kind, bound_source,
    bound_target), where ``current`` is the owner's revision.  The first rule that fits decides.  A claim on an
    unbound site binds it, one with the bound target corroborates it, one with another target conflicts, and
    nothing wins.
    """
    j = claims.join(sites.withColumn("_there", F.lit(True)), "site", "left")
    outcome = (
        F.when(F.col("site").isNull(), "REJECT_NO_OCCURRENCE")
        .when(~F.col("resolved"), "REJECT_NOT_RESOLVED")
        .when(F.col("kind").isNull(), "REJECT_NO_KIND")
        .when(F.col("source").isNull(), "REJECT_NO_SOURCE")
        .when(F.col("_there").isNull(), "REJECT_UNANCHORED")
        .when(F.col("revision") != F.col("current"), "REJECT_STALE")
        .when(F.col("bound_kind").isNull(), "BINDING")
        .when((F.col("bound_kind") != F.col("kind")) | (F.col("bound_source") != F.col("source")), "REJECT_BOUND_ELSEWHERE")
        .when(F.col("bound_target") == F.col("target"), "CORROBORATING")
        .otherwise("CONFLICT")
    )
    return j.select("claim", outcome.alias("outcome"))


#: The accesses that make a literal a key, by the domain they read.
KEY_APIS = {
    "os.getenv": "USES_ENV",
    "os.environ": "USES_ENV",
    "process.env.": "USES_ENV",
    "process.env[]": "USES_ENV",
    "std::env::var": "USES_ENV",
    "Environment.GetEnvironmentVariable": "USES_ENV",
    "ConfigurationManager.AppSettings": "USES_CONFIG",
    "ConfigurationManager.ConnectionStrings": "USES_CONFIG",
}


def domain_relation(api: Column, key: Column) -> Column:
    """(kind, identity, reason): the relation of a key access; a key that is no literal is a gap."""
    kind = F.lit(None).cast("string")
    for name, value in KEY_APIS.items():
        kind = F.when(api == name, value).otherwise(kind)
    domain = F.when(kind == "USES_ENV", "ENV").when(kind == "USES_CONFIG", "CONFIG")
    known = kind.isNotNull() & key.isNotNull()
    reason = F.when(kind.isNull(), "NOT_A_KEY").when(key.isNull(), "DYNAMIC_KEY")
    return F.struct(F.when(known, kind).alias("kind"), F.when(known, F.concat(domain, F.lit(":"), key)).alias("identity"), reason.alias("reason"))
