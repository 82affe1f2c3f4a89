"""Schemas of the tables; nothing is inferred. Percentages are doubles in [0, 100], null is "not measured"."""

from __future__ import annotations

RUN_LOG = (
    "run_id string, time_stamp long, node_name string, origin string, class_index int, test_class string, compiler_success boolean, suite_green boolean, "
    "compiler_feedback string, tests_run int, tests_failed int, line_coverage string, branch_coverage string, mutation string, repair_attempts int, mutation_iterations int"
)
LLM_CALLS = (
    "run_id string, time_stamp long, node_name string, prompt string, response struct<data:struct<content:string,usage_metadata:struct<input_tokens:long,output_tokens:long,total_tokens:long>,"
    "tool_calls:array<struct<name:string,id:string,args:string>>,response_metadata:struct<total_duration:long,eval_duration:long,eval_count:long>,additional_kwargs:struct<reasoning_content:string>>>"
)
PROMPTS = "class_key string, project string, prompt string, prompt_tokens int, excluded boolean"
GENERATIONS = (
    "class_key string, project string, rollout int, text string, finish_reason string, chars int, max_tokens int, temperature double, top_p double, top_k int, seed long, request_seconds double, sampled_at string"
)
_SUITE = "tests_run int, {0}tests_passed int, {0}tests_failed int, {0}branch_coverage_pct double, {0}mutation_score_pct double, {0}line_coverage_pct double, {0}n_branches int"
SCORES = ", ".join([
    "class_key string, project string, rollout int, class_under_test string, status string, tier_reached int, n_tests int, n_assertless_tests int, parses boolean, terminated boolean, compiled boolean",
    _SUITE.format(""),
    "green_subset_mutation_score_pct double, green_subset_branch_coverage_pct double, green_subset_line_coverage_pct double, green_subset_n_branches int, n_tests_dropped_for_green int, green_subset_seconds double",
    "n_tests_clean int, n_tests_broken int, n_skeleton_errors int, n_compile_errors int, errors_truncated boolean, attribution_available boolean, salvaged boolean",
    "salvaged_" + _SUITE.format("salvaged_"),
    "salvage_seconds double, compiler_output string, wall_time_s map<string,double>, finish_reason string, compiled_fraction double, effective_coverage_pct double, pass_rate double, "
    "is_green boolean, salvaged_is_green boolean, usable_for_training boolean, quality double, quality_graded double, quality_v2 double, scored_at string, score_seconds double",
])
RESCUES = "class_key string, project string, run_id string, status string, minutes double, suite struct<source:string,mutation_score_pct:double,n_tests:int,log_rows:int>"
TARGETS = "class_key string, kind string, round int, source string"
SELECTION = "class_key string, project string, attempts array<struct<rollout:int,why:string,rounds:int,line_coverage_pct:double>>, selected struct<rollout:int,quality:double,score_field:string,source:string,kept_fraction:double,n_kept_tests:int>"
SFT = "instruction string, input string, output string"
REFERENCES = "class_key string, tokens int"
CHECKPOINT = "class_index int, run_id string, input_tokens long, output_tokens long, runtime_seconds double, assertless int"
MEMBER = "struct<name:string,kind:string,visibility:string,static:boolean,abstract:boolean,params:array<string>,returns:string,declared_in:string,decl:string,overrides:string>"
CLASS_INDEX = (
    "class string, kind string, package string, path string, visibility string, extends array<string>, implements array<string>, ctor_params array<string>, method_params array<string>, returns array<string>, "
    f"throws array<string>, fields array<string>, instantiates array<string>, references array<string>, doc_links array<string>, calls map<string,array<string>>, members array<{MEMBER}>"
)
RESULT = "run_id string, arm string, class string, project string, status string, minutes double"

TABLES = {k.lower(): v for k, v in list(globals().items()) if k.isupper() and isinstance(v, str) and k[0] != "_" and k != "MEMBER"}
