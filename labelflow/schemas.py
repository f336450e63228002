"""Record layouts shared by sources, operators and streams."""

from __future__ import annotations

LABELLED = "text string, score string"
TASK = "text string, target string"
INSTRUCTION = "instruction string, input string, output string"
# Labels arrive as numbers in one file and as strings in the next; VARIANT keeps the difference.
CLASSIFIER = (
    "id long, sentence string, text string, instruction string, input string, "
    "label variant, labels variant, score variant, output variant"
)
SCORING_CSV = "text string, target int, output string, model_name string, prompt_type string"
EXPERIMENT = (
    "id string, original_text string, original_score int, model string, prompt_type string, "
    "use_data boolean, target_level int, generated_text string, predicted_score int, is_correct boolean"
)
EVALUATION = "id long, text string, gold_label_id int, pred_label_id int, is_correct boolean"
ACTIVITY = (
    "timestamp timestamp, input_text string, target_level string, output_text string, "
    "predicted_score int, success boolean, ip_address string"
)
FOLD_METRICS = "fold int, eval_accuracy double, eval_macro_f1 double, eval_loss double"
PAIRED_EXAMPLE = "original string, by_level map<int,string>"
REPLY = "reply string, attempts int, status string, error string"
