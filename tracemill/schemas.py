"""Declared schemas of records, predictions, rollouts, telemetry and logs."""

CALL = "struct<op: string, a: double, b: double>"
MESSAGE = (
    "struct<role: string, content: string, tool_calls: array<struct<id: string, type: string, "
    f"function: struct<name: string, arguments: {CALL}>>>, name: string, tool_call_id: string>"
)
RECORDS = (
    f"pos bigint, id string, expression string, messages array<{MESSAGE}>, final_answer double, naive_left_to_right_answer double, "
    "operation_count bigint, tool_call_count bigint, tier string, num_terms bigint, max_factors_in_a_term bigint, ood_type string, "
    "source_operands array<double>, training_mix string, training_domain string, split string"
)
PREDICTIONS = (
    "pos bigint, id string, seed bigint, variant string, run_signature string, expression string, tier string, final_answer double, "
    "predicted_answer double, answer_correct boolean, used_tool boolean, valid_tool_use boolean, parseable_completion boolean, "
    "tool_call_count bigint, expected_tool_call_count bigint, tool_call_count_correct boolean, semantic_trace_valid boolean, "
    f"semantic_trace_complete boolean, exact_trace boolean, task_success boolean, error string, model_calls array<{CALL}>, "
    f"expected_calls array<{CALL}>, generated_turns array<string>, generated_token_counts array<bigint>, total_generated_tokens bigint, "
    "thinking_budget_exhausted boolean, total_generation_time double"
)
TELEMETRY = (
    "timestamp_utc string, memory_used_mib double, memory_total_mib double, memory_free_mib double, gpu_utilization_percent double, power_draw_watts double"
)
LOG = "pos int, step int, entry map<string,double>"
#: The metrics of a prediction that are averaged.
METRICS = (
    "answer_correct", "used_tool", "valid_tool_use", "parseable_completion", "tool_call_count_correct", "semantic_trace_valid",
    "semantic_trace_complete", "exact_trace", "task_success", "thinking_budget_exhausted",
)
SPLITS = ("train", "eval", "test", "ood_length", "ood_negative", "ood_float")
TIERS = ("easy", "medium", "hard")
