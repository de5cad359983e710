"""The registered queries of the numbered operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import documents

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.media import encode_media, media_digest

    return media_digest(encode_media(documents(spark, sf_dir)), padded_tail=True)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.simhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_file() -> str:
    """The public vocabulary that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_file())


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.pii import KINDS, find_personal_data

    found = find_personal_data(documents(spark, sf_dir))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.repeats import remove_repeats

    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.html_text import extract_text

    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.language import learn, predict

    rows = documents(spark, sf_dir)
    found = predict(rows, learn(rows))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.bpe import round_trip

    return round_trip(documents(spark, sf_dir), tokenizer_file())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm.line_dedup import dedup_lines

    found = dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def manifest_report(rows: DataFrame) -> DataFrame:
    """Proofs of the documents' manifest, some of the leaves taken from changed texts."""
    from ridgeline.llm.merkle import FIELDS, leaf, verified_rows

    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    text = F.when(tampered, F.translate("text", CAPITALS, CAPITALS.lower())).otherwise(F.col("text"))
    return verified_rows(rows, leaf(*(text if c == "text" else F.col(c) for c in FIELDS))).withColumnRenamed("id", "doc_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_report(documents(spark, sf_dir))


def contamination_report(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Counts and digests of contamination() over the documents."""
    from ridgeline.llm.decontaminate import contamination

    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = contamination(rows, items)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def runs_report(rows: DataFrame) -> DataFrame:
    """Digests of periodic_runs over the documents, some of which are made periodic first."""
    from ridgeline.llm.runs import made_periodic, periodic_runs

    seed = F.crc32(F.col("doc_id").cast("string"))
    found = periodic_runs(rows.select("doc_id", made_periodic(F.col("text"), seed).alias("text")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_personal_data": op5_personal_data,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_html_text": op7_html_text,
    "op8_language": op8_language,
    "op9_bpe": op9_bpe,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_decontamination": op12_decontamination,
    "op13_periodic_runs": op13_periodic_runs,
}

SPACES = r"'[\x20\x09-\x0D]+'"


def merkle_sql(group_levels: int = 7, top_levels: int = 4) -> str:
    """SQL of op11 for at most 8 ** group_levels rows of a lang and 8 ** top_levels langs: one step for each level.

    Level k of a tree has rows (g, n, d, c): group, number, digest, vertices of that level. Where c is 1 the tree ends.
    """
    hashed = lambda x: f"coalesce(strlen(cast({x} as varchar)) || ':' || cast({x} as varchar), '-')"
    leaf = lambda text: f"sha256({hashed('doc_id')} || {hashed('source')} || {hashed('lang')} || {hashed('n_chars')} || {hashed(text)})"
    steps = "flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: [cast(ascii(x) as bigint), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {steps}), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
    ctes = [
        f"given as (select doc_id, lang as g, {leaf('text')} as leaf, case when {crc} % 3 = 0 then {leaf(f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')")} else {leaf('text')} end as seen from documents)",
        "leaves as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as n, count(*) over (partition by g) as c from given)",
        "g0 as (select g, n, leaf as d, c from leaves)",
    ]

    def tree(name: str, levels: int) -> None:
        for k in range(levels):
            ctes.append(f"{name}{k + 1} as (select g, n // 8 as n, sha256(string_agg(d, '' order by n)) as d, (any_value(c) + 7) // 8 as c from {name}{k} where c > 1 group by g, n // 8)")
        ends = " union all ".join(f"select g, d from {name}{k} where c = 1" for k in range(levels + 1))
        ctes.append(f"{name}_ends as ({ends})")

    def paths(name: str, levels: int, start: str) -> str:
        """The siblings and the folded digest of each row of `start` (g, n, c, now, proof), level by level."""
        at = start
        for k in range(levels):
            ctes.append(f"{name}_run{k} as (select g, n // 8 as p, list(d order by n) as ds from {name}{k} where c > 1 group by g, n // 8)")
            own = f"cast(({at}.n // {8**k}) % 8 + 1 as bigint)"
            left, right = f"ds[1:{own} - 1]", f"ds[{own} + 1:]"
            folded = f"sha256(array_to_string({left}, '') || now || array_to_string({right}, ''))"
            ctes.append(f"{name}_path{k} as (select {at}.* exclude (now, proof), case when ds is null then now else {folded} end as now, case when ds is null then proof else proof || array_to_string({left}, '') || array_to_string({right}, '') end as proof from {at} left join {name}_run{k} r on r.g is not distinct from {at}.g and r.p = {at}.n // {8 ** (k + 1)})")
            at = f"{name}_path{k}"
        return at

    tree("g", group_levels)
    ctes.append("t0 as (select 'all' as g, row_number() over (order by g nulls first) - 1 as n, d, count(*) over () as c, g as lang from g_ends)")
    tree("t", top_levels)
    ctes.append("begun as (select *, seen as now, '' as proof from leaves)")
    ctes.append(f"below as (select * from {paths('g', group_levels, 'begun')})")
    ctes.append("above as (select doc_id, leaf, seen, t0.g, t0.n, t0.d as subroot, now, proof from below join t0 on below.g is not distinct from t0.lang)")
    last = paths("t", top_levels, "above")
    return f"with {', '.join(ctes)} select doc_id, leaf, subroot, t_ends.d as root, sha256(proof) as proof_sha256, now as folded_root, now = t_ends.d as verified from {last} cross join t_ends"


SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), {SPACES}, ' ', 'g')) as h from documents)
        select doc_id, min(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
               doc_id = min(doc_id) over (partition by h) as kept, h as text_sha256 from t""",
    "op11_merkle_manifest": merkle_sql(),
    "op12_decontamination": f"""
        with docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
        items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
        sizes as (select item_id, w, least(10, len(w)) as n from items where len(w) > 0),
        windows as (select distinct item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') as g from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from sizes)),
        lengths as (select distinct n from sizes),
        seen as (select r, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, lengths where len(w) >= n)),
        hits as (select r, item_id, s.n, i from seen s join windows using (n, g)),
        words as (select r, count(distinct i + k) as n_hit from (select r, i, unnest(range(n)) as k from hits) group by r),
        named as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, coalesce(cast(item_id as varchar), '') as id from hits) group by r)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from docs left join words using (r) left join named using (r)""",
}
