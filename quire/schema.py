"""Schemas of the tables that operators exchange.

Everything is partitioned by ``doc_id``; order is always an explicit column.
"""

PAGES = "doc_id bigint, page_no int, text string, n_tokens int"
TOC_ITEMS = "doc_id bigint, idx int, structure string, title string, page_num int, physical_index int, appear_start boolean"
NODES = (
    "doc_id bigint, ord int, node_id string, parent_ord int, depth int, level int, structure string, title string,"
    " start_index int, end_index int, line_num int, text string, n_tokens int, summary string, prefix_summary string"
)
CHUNKS = "doc_id bigint, chunk_no int, first_page int, last_page int, n_tokens int, text string"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,reasoning_tokens:bigint,total_tokens:bigint,cached_tokens:bigint>"
JUDGE = "struct<pass:boolean,score_0_to_1:double,missing_facts:array<string>,hallucinations:array<string>,citation_quality:string,rationale:string>"
EVAL_CASES = "suite string, case_id string, document string, question string, reference_answer string, required_facts array<string>, forbidden_claims array<string>"
EVAL_RESULTS = (
    f"model string, mode string, case_id string, status string, judge {JUDGE}, retrieval_usage {USAGE}, answer_usage {USAGE},"
    f" model_usage {USAGE}, judge_usage {USAGE}, total_latency_sec double, error string"
)
