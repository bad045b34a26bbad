"""Schemas of the relations that operators pass on."""

MANIFEST = "folder_id string, folder_name string, file_id string, file_name string, scan_pos bigint"
KEYS = ["folder_name", "file_name"]
LINES = "array<string>"
DECISION = (
    "struct<is_handwritten: boolean, _cfg: string, decision: string, reason: string, handwritten_ratio: double, "
    "non_blank_tiles: int, global_printed_prob: double, global_handwritten_prob: double, error: string>"
)
READINGS = "array<struct<box: array<int>, text: string, score: double>>"
READ = f"readings {READINGS}, error string"
TRANSCRIPTION = "folder_name string, file_name string, status string, text string, error string"
IMAGE = "struct<height: int, width: int, data: binary>"
