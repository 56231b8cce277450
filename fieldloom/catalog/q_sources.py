"""Queries over document metadata, run metrics, hosts, manifests and timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.catalog.views import oracle, spark_view
from fieldloom.functions.values import document_format, format_extension
from fieldloom.operators import fleet, metrics
from fieldloom.sources import documents as document_source

_FORMAT_SQL = "case when magic_hex='255044462D' then 'pdf' when magic_hex='FFD8FF' then 'jpeg' end"


def described(spark, sf_dir):
    docs = spark_view(spark, sf_dir, "v_docs")
    return docs.withColumn("format", document_format(F.unhex("magic_hex")))


@query(
    "src1_supported_paths",
    "SRC-1",
    oracle(
        """select doc_id, source_path, regexp_extract(source_path,'[^/]*$') file_name, regexp_replace(source_path,'/[^/]*$','') dir
from v_docs where lower(source_path) like '%.pdf' or lower(source_path) like '%.jpg' or lower(source_path) like '%.jpeg'""",
        "v_docs",
    ),
)
def supported_paths(spark, sf_dir):
    from fieldloom.functions.text import base_name, parent_dir

    docs = spark_view(spark, sf_dir, "v_docs")
    path = F.col("source_path")
    return docs.filter(document_source.is_supported_path(path)).select(
        "doc_id", path, base_name(path).alias("file_name"), parent_dir(path).alias("dir")
    )


@query(
    "src2_admission_rules",
    "SRC-2",
    oracle(
        f"""select doc_id, case when byte_len>52428800 then 'upload exceeds the 52428800-byte limit'
 when magic_hex='89504E47' then 'upload must be a PDF or JPEG file'
 when magic_hex='255044462D' and page_count=0 then 'PDF has no pages'
 when magic_hex='255044462D' and page_count>200 then 'PDF has too many pages (> 200)'
 when magic_hex='FFD8FF' and (width>8000 or height>8000) then 'JPEG dimensions ('||width||'x'||height||') exceed the 8000px-per-side limit' end reject_reason
from v_docs""",
        "v_docs",
    ),
)
def admission_rules(spark, sf_dir):
    accepted, refused = document_source.admit(described(spark, sf_dir))
    return accepted.select("doc_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        refused.select("doc_id", "reject_reason")
    )


@query(
    "src3_format_sniff",
    "SRC-3",
    oracle(
        f"select doc_id, {_FORMAT_SQL} format, case {_FORMAT_SQL} when 'pdf' then '.pdf' when 'jpeg' then '.jpg' end extension from v_docs",
        "v_docs",
    ),
)
def format_sniff(spark, sf_dir):
    return described(spark, sf_dir).select(
        "doc_id", "format", format_extension(F.col("format")).alias("extension")
    )


def runs(spark, sf_dir):
    view = spark_view(spark, sf_dir, "v_runs")
    pages = F.when(F.col("ocr_page") > 0, F.array(F.col("ocr_page"))).otherwise(
        F.array().cast("array<bigint>")
    )
    return view.withColumn("pages_ocr", pages)


@query(
    "flt10_metric_constraints",
    "FLT-10",
    oracle(
        """select doc_id, concat_ws(',', case when total_ms<0 then 'total_ms' end, case when pages_total<1 then 'pages_total' end,
  case when input_tokens<0 then 'input_tokens' end, case when tokens_per_second<0 then 'tokens_per_second' end,
  case when ocr_page>0 and ocr_page>pages_total then 'pages_ocr' end) violations from v_runs""",
        "v_runs",
    ),
)
def metric_constraints(spark, sf_dir):
    accepted, refused = metrics.split_runs(runs(spark, sf_dir))
    return accepted.unionByName(refused).select(
        "doc_id", F.array_join("violations", ",").alias("violations")
    )


@query(
    "prj5_provenance_texts",
    "PRJ-5",
    oracle(
        """select doc_id, case extraction_source when 'xml' then 'ZUGFeRD / Factur-X XML' when 'xml_and_model' then 'XML + AI' else 'Document text + AI' end
   ||case when ocr_page>0 then ' (OCR)' else '' end source_label,
 case xml_status when 'supported' then 'Detected and used ('||n_xml_fields||' of 5 fields)'
   when 'unsupported' then case when xml_profile_id is not null then 'Detected but uses an unsupported invoice profile ('||xml_profile_id||'); used AI instead'
     else 'Detected but not a supported invoice format; used AI instead' end
   when 'invalid' then 'Detected but not valid XML; used AI instead'
   when 'ambiguous' then 'Multiple different invoice XML attachments found; used AI instead' end xml_detection
from v_runs""",
        "v_runs",
    ),
)
def provenance_texts(spark, sf_dir):
    return runs(spark, sf_dir).select(
        "doc_id",
        metrics.source_label(F.col("extraction_source"), F.col("pages_ocr")).alias("source_label"),
        metrics.xml_detection(
            F.col("xml_status"), F.col("n_xml_fields"), F.col("xml_profile_id")
        ).alias("xml_detection"),
    )


@query(
    "win2_call_labels",
    "WIN-2",
    oracle(
        """, calls as (select user_id run_id, row_number() over (partition by user_id order by ts, event_id) call_no,
   case when event_id%3=0 then 'shortening' else 'extraction' end phase, case when event_type='error' then 'boom' end error from events),
numbered as (select *, row_number() over (partition by run_id, phase order by call_no)-1 i from calls)
select run_id, call_no, phase, i phase_index, case phase when 'extraction' then 'Extraction' else 'Shortening' end
  ||case when i>0 then ' retry '||i else '' end||case when error is not null then ' — failed' else '' end label from numbered""",
        "v_docs",
    ),
)
def call_labels(spark, sf_dir):
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "user_id run_id",
        "cast(row_number() over (partition by user_id order by ts, event_id) as bigint) call_no",
        "case when event_id%3=0 then 'shortening' else 'extraction' end phase",
        "case when event_type='error' then 'boom' end error",
    )
    return metrics.label_calls(calls).select(
        "run_id", "call_no", "phase", F.col("phase_index").cast("bigint").alias("phase_index"), "label"
    )


@query(
    "plan4_run_metrics",
    "PIPE-4",
    oracle(
        """, clocks as (select doc_id, abs(total_ms) read_ms, abs(total_ms)%97 ocr_ms, doc_id%53 inference_ms, case when doc_id%2=0 then doc_id%7 end xml_ms from v_runs)
select doc_id, greatest(read_ms-ocr_ms,0) pdf_extraction_ms, coalesce(xml_ms,0)+greatest(read_ms-ocr_ms,0)+ocr_ms+inference_ms total_ms from clocks""",
        "v_runs",
    ),
)
def run_metrics(spark, sf_dir):
    clocks = spark_view(spark, sf_dir, "v_runs").selectExpr(
        "doc_id",
        "abs(total_ms) read_ms",
        "abs(total_ms)%97 ocr_ms",
        "doc_id%53 inference_ms",
        "case when doc_id%2=0 then doc_id%7 end xml_ms",
    )
    return metrics.assemble_metrics(clocks).select("doc_id", "pdf_extraction_ms", "total_ms")


@query(
    "join10_fleet_fit",
    "JOIN-10",
    oracle(
        """, judged as (select *, case memory_tier when 'small' then 8 when 'medium' then 16 else 32 end floor_gb from v_fleet)
select host_id, model_id, not (memory_gb<floor_gb or (not installed and free_disk_gb<size_gb)) compatible,
 case when installed then 'installed' else 'not_installed' end status,
 concat_ws('|', case when memory_gb<floor_gb then 'needs at least '||floor_gb||' GB memory; this device has '||memory_gb||' GB' end,
   case when not installed and free_disk_gb<size_gb then printf('needs %.1f GB free disk; this device has %.1f GB', size_gb, free_disk_gb) end) reasons
from judged""",
        "v_fleet",
    ),
)
def fleet_fit(spark, sf_dir):
    return fleet.fit_hosts(spark_view(spark, sf_dir, "v_fleet")).select(
        "host_id", "model_id", "compatible", "status", F.array_join("reasons", "|").alias("reasons")
    )


def manifests(spark, sf_dir):
    view = spark_view(spark, sf_dir, "v_manifest")
    expected = view.select("model_id", "path", "expected_size", "expected_digest")
    observed = view.filter(F.col("observed_size").isNotNull()).select(
        "model_id", "path", "observed_size", "observed_digest"
    )
    return expected, observed


_AUDIT_SQL = """audit as (select model_id, path, case when observed_size is null then 'missing' when observed_size<>expected_size then 'size mismatch'
  when observed_digest<>expected_digest then 'checksum mismatch' else 'verified' end verdict from v_manifest)"""


@query("join11_manifest_audit", "JOIN-11", oracle(f", {_AUDIT_SQL} select * from audit", "v_manifest"))
def manifest_audit(spark, sf_dir):
    return fleet.audit_files(*manifests(spark, sf_dir)).select("model_id", "path", "verdict")


@query(
    "join11_installed_models",
    "JOIN-11",
    oracle(
        f", {_AUDIT_SQL} select model_id, bool_and(verdict not in ('missing','size mismatch')) installed from audit group by 1",
        "v_manifest",
    ),
)
def installed_models(spark, sf_dir):
    return fleet.installed_models(fleet.audit_files(*manifests(spark, sf_dir)))


@query(
    "agg15_model_sizes",
    "AGG-15",
    oracle("select model_id, cast(sum(expected_size) as bigint) total_size from v_manifest group by 1", "v_manifest"),
)
def model_sizes(spark, sf_dir):
    return fleet.model_sizes(manifests(spark, sf_dir)[0])


@query(
    "join12_display_names",
    "JOIN-12",
    oracle(
        """select f.host_id, f.model_id, coalesce(n.p_name, cast(f.model_id as varchar)) display_name
from v_fleet f left join (select p_partkey, p_name from part where p_size>10) n on f.model_id=n.p_partkey""",
        "v_fleet",
    ),
)
def display_names(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size > 10")
    catalog = names.selectExpr("p_partkey model_id", "p_name display_name")
    return fleet.with_display_names(spark_view(spark, sf_dir, "v_fleet"), catalog).select(
        "host_id", "model_id", "display_name"
    )


@query(
    "num4_memory_severity",
    "NUM-4",
    oracle(
        """select seq, case when not ok then 'none' when available_mb*100.0/total_mb<10 then 'critical'
 when available_mb*100.0/total_mb<25 then 'warning' else 'none' end severity from v_mem""",
        "v_mem",
    ),
)
def memory_severity(spark, sf_dir):
    samples = spark_view(spark, sf_dir, "v_mem")
    severity = fleet.memory_severity(F.col("available_mb"), F.col("total_mb"), ~F.col("ok"))
    return samples.select("seq", severity.alias("severity"))


@query(
    "st8_memory_status",
    "ST-8",
    oracle(
        """, good as (select host_id, arg_max(available_mb, (ts, seq)) available_mb, arg_max(total_mb, (ts, seq)) total_mb,
    arg_max(coalesce(loaded_entry_id,''), (ts, seq)) loaded, max((ts, seq)) moment from v_mem where ok group by 1),
bad as (select host_id, max((ts, seq)) moment from v_mem where not ok group by 1),
both_sides as (select host_id, available_mb, total_mb, nullif(loaded,'') loaded, coalesce(b.moment>g.moment, b.moment is not null) stale from good g full join bad b using (host_id))
select host_id, available_mb, stale, case when stale then 'none' when available_mb*100.0/total_mb<10 then 'critical'
  when available_mb*100.0/total_mb<25 then 'warning' else 'none' end severity,
  coalesce('Loaded '||loaded,'No model loaded')||case when stale then ' (last known)' else '' end residency from both_sides""",
        "v_mem",
    ),
)
def memory_status(spark, sf_dir):
    latest = fleet.latest_memory(spark_view(spark, sf_dir, "v_mem"))
    return latest.select(
        "host_id",
        "available_mb",
        "stale",
        "severity",
        fleet.residency_text(F.col("loaded_entry_id"), F.col("stale")).alias("residency"),
    )


@query(
    "agg13_launch_medians",
    "AGG-13",
    oracle(
        """, long as (select config_id, case when run_no=1 then 'first' else 'rest' end sample, 'total' phase, total v from v_timing
 union all select config_id, case when run_no=1 then 'first' else 'rest' end, 'entry', entry from v_timing
 union all select config_id, case when run_no=1 then 'first' else 'rest' end, 'ready', total-entry from v_timing)
select config_id, sample, phase, round(median(v),9) median_value from long where v is not null group by all""",
        "v_timing",
    ),
)
def launch_medians(spark, sf_dir):
    medians = fleet.launch_medians(spark_view(spark, sf_dir, "v_timing"))
    return medians.select("config_id", "sample", "phase", F.round("median", 9).alias("median_value"))
