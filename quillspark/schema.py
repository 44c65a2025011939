"""Schemas of the engine's tables (see FIXTURES.md) and the fixed field list."""

#: The fields of a record, in order.
FIELDS = [
    "passport_type",
    "issuing_country",
    "surname",
    "given_names",
    "passport_number",
    "sex",
    "date_of_birth",
    "place_of_birth",
    "nationality_current",
    "nationality_at_birth",
    "date_of_issue",
    "date_of_expiry",
    "issuing_authority",
    "personal_number",
]
CODE_FIELDS = ["passport_type", "issuing_country", "sex", "nationality_current", "nationality_at_birth"]
DATE_FIELDS = ["date_of_birth", "date_of_issue", "date_of_expiry"]
STATUSES = ["pending", "ocr_done", "reviewing", "reviewed", "error"]

BOX = "struct<left:int,top:int,right:int,bottom:int,width:int,height:int>"
RECORDS = (
    "id bigint, image_path string, extracted_json string, reviewed_json string, layoutlm_json string, layoutlm_reviewed_json string, "
    "status string, raw_ocr_text string, error_message string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
WORDS = f"doc_id bigint, id string, text string, confidence double, polygon array<array<int>>, bbox {BOX}, line_id string, `order` int, rotation double"
LINES = f"doc_id bigint, image_width int, image_height int, id string, text string, confidence double, polygon array<array<int>>, bbox {BOX}, word_ids array<string>, `order` int, rotation double"
CODE_VALUES = "code_id string, code_value string, code_value_des string"
FIELD_MAP = ", ".join(f"{f} string" for f in FIELDS)
PAYLOAD = "file_name string, tokens array<string>, bboxes array<array<int>>, ner_tags array<string>"
