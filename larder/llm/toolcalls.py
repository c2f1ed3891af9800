"""Tool calls of chats: linked to their results, put in order, checked, and written as JSON.

Built-in functions only. Calls and results meet by identifier in a hash join. The order
comes from the calls a call depends on: level 0 needs none, every other level the ones
before it. Arguments are read as variants and held against a table of tools. A message is
canonical JSON: sorted keys, no spaces.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from larder.session import Workspace

#: Of each tool: parameter -> (kind, required).
Tools = Mapping[str, Mapping[str, tuple[str, bool]]]


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (call_id, conv_id, turn, name, arguments, depends) with results (call_id, turn, content).

    One row per identifier of either side, with status: linked, pending (no result),
    orphan (no call), unnamed (a null identifier, one row per such call or result). Of
    several calls or results of one identifier the earliest turn counts, then the least
    text; n_calls and n_results say how many there were. They are brought down to one
    before the join, so a hot identifier costs one row per task.
    """
    call = F.struct("conv_id", "turn", "name", "arguments", "depends")
    result = F.struct(F.col("turn").alias("result_turn"), "content")
    one_call = calls.filter("call_id is not null").groupBy("call_id").agg(
        F.min(call).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    one_result = results.filter("call_id is not null").groupBy("call_id").agg(
        F.min(result).alias("r"), F.count(F.lit(1)).alias("n_results"))
    met = one_call.join(one_result, "call_id", "full")
    rows = met.select("call_id", "c.*", "r.*", F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
                      F.coalesce("n_results", F.lit(0)).alias("n_results"))
    unnamed = calls.filter("call_id is null").select("call_id", "conv_id", "turn", "name", "arguments", "depends").withColumns({
        "result_turn": F.lit(None).cast("long"), "content": F.lit(None).cast("string"),
        "n_calls": F.lit(1), "n_results": F.lit(0)})
    lost = results.filter("call_id is null").select(
        "call_id", F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.lit(None).cast("array<string>").alias("depends"), F.col("turn").alias("result_turn"), "content",
        F.lit(0).alias("n_calls"), F.lit(1).alias("n_results"))
    status = (F.when(F.col("call_id").isNull(), "unnamed").when(F.col("n_calls") == 0, "orphan")
              .when(F.col("n_results") == 0, "pending").otherwise("linked"))
    return rows.unionByName(unnamed).unionByName(lost).withColumn("status", status)


def levels(rows: DataFrame, work: Workspace) -> DataFrame:
    """(call_id, level) of every call: the longest chain of calls of its conversation before it.

    Dependencies on unknown calls, or on calls of another conversation, are ignored. A
    call that depends on itself, directly or through others, has no level and is left
    out. One round settles one level, so there are as many rounds as the longest chain.
    """
    calls = rows.filter("call_id is not null and n_calls > 0").select("call_id", "conv_id", "depends")
    needs = calls.select("call_id", "conv_id", F.explode("depends").alias("needed")).distinct()
    known = calls.select(F.col("call_id").alias("needed"), F.col("conv_id").alias("_conv"))
    edges = work.keep(needs.join(known, "needed").filter(F.col("conv_id").eqNullSafe(F.col("_conv")))
                      .select("call_id", "needed"), "needs")
    done = work.keep(calls.join(edges, "call_id", "left_anti").select("call_id", F.lit(0).alias("level")), "level")
    out, level = done, 0
    while not edges.isEmpty():
        settled = done.select(F.col("call_id").alias("needed"), F.lit(True).alias("settled"))
        state = edges.join(settled, "needed", "left")
        waiting = work.keep(state.filter("settled is null").select("call_id", "needed"), "needs")
        ready = state.join(waiting.select("call_id"), "call_id", "left_anti").select("call_id").distinct()
        level += 1
        done = work.keep(ready.select("call_id", F.lit(level).alias("level")), "level")
        if done.isEmpty():
            break
        out, edges = out.unionByName(done), waiting
    return out


def _kinds(value: Column) -> Column:
    """Kind of a variant by JSON's own words; numbers without a fraction are integers."""
    kind = F.schema_of_variant(value)
    return (F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
            .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
            .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
            .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("null"))


def problems(name: Column, arguments: Column, tools: Tools) -> Column:
    """What is wrong with a call, as sorted codes; an empty array is a valid call.

    ``tool``: unknown or null name. ``json``: no JSON object. ``missing:p``, ``type:p``,
    ``unknown:p``: by parameter. An integer also serves where a number is asked for; a
    null value counts as missing where the parameter is required.
    """
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    keys = F.json_object_keys(arguments)
    found: list[Column] = []
    for tool, parameters in tools.items():
        own = name.eqNullSafe(F.lit(tool))
        for p, (kind, required) in parameters.items():
            value = F.try_variant_get(parsed, f"$.{p}", "variant")
            absent = value.isNull() | F.is_variant_null(value)
            fits = _kinds(value).isin(*({"number": ["number", "integer"]}.get(kind, [kind])))
            if required:
                found.append(F.when(own & is_object & absent, f"missing:{p}"))
            found.append(F.when(own & is_object & ~absent & ~fits, f"type:{p}"))
        strange = F.transform(F.array_except(keys, F.array(*[F.lit(p) for p in parameters])),
                              lambda k: F.concat(F.lit("unknown:"), k))
        found.append(F.when(own & is_object, F.array_join(strange, "\n")))
    named = name.isin(*tools) & name.isNotNull()
    found += [F.when(~F.coalesce(named, F.lit(False)), "tool"), F.when(~is_object, "json")]
    codes = F.split(F.array_join(F.array(*found), "\n"), "\n")
    return F.array_sort(F.array_distinct(F.filter(codes, lambda c: c != "")))


def canonical(arguments: Column) -> Column:
    """JSON with sorted keys and no spaces; null where it is none."""
    return F.to_json(F.try_parse_json(arguments))


def formatted(calls: DataFrame, results: DataFrame, tools: Tools) -> DataFrame:
    """One row per call, and per orphan result: where it stands, what is wrong, its message.

    Columns: call_id, conv_id, turn, level, status, problems, message. status is that of
    ``linked``, or cyclic for a call that depends on itself; level is null where there is
    none. Reading a conversation by (level, turn, call_id) is a topological order. The
    message is an object of arguments (null if they are no JSON), call_id, name and
    result. Extra columns of the inputs are not read; empty inputs give an empty result.
    """
    work = Workspace(calls.sparkSession, "toolcalls")
    rows = work.keep(linked(calls, results), "linked")
    placed = rows.join(levels(rows, work), "call_id", "left")
    cyclic = F.col("call_id").isNotNull() & (F.col("n_calls") > 0) & F.col("level").isNull()
    wrong = F.when(F.col("n_calls") > 0, F.array_join(problems(F.col("name"), F.col("arguments"), tools), ","))
    text = [F.to_json(F.struct(F.col(c).alias(c))) for c in ("call_id", "name")]
    pair = [F.when(F.col(c).isNull(), F.lit(f'"{c}":null')).otherwise(F.substring(t, F.lit(2), F.length(t) - 2))
            for c, t in zip(("call_id", "name"), text)]
    content = F.to_json(F.struct(F.col("content").alias("result")))
    result = F.when(F.col("content").isNull(), F.lit('"result":null')).otherwise(
        F.substring(content, F.lit(2), F.length(content) - 2))
    message = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(","),
                       pair[0], F.lit(","), pair[1], F.lit(","), result, F.lit("}"))
    return placed.select("call_id", "conv_id", "turn", F.col("level").cast("int").alias("level"),
                         F.when(cyclic, "cyclic").otherwise(F.col("status")).alias("status"),
                         wrong.alias("problems"), message.alias("message"))
