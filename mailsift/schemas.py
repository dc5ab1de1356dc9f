"""Explicit schemas, as DDL, shared by batch and streaming jobs."""

EMAILS = ("email_id LONG, received_at TIMESTAMP, sender_id LONG, body STRING, raw_headers STRING, label STRING")
BAD_DOMAINS = ("domain STRING, reason STRING, added_at TIMESTAMP")
BAD_PATTERNS = ("pattern STRING, type STRING, added_at TIMESTAMP")
FEEDBACK = ("id LONG, timestamp TIMESTAMP, email_text STRING, predicted_label STRING, "
                "correct_label STRING, model_used STRING")
USAGE_LOGS = ("id LONG, user_id LONG, endpoint STRING, request_body STRING, "
                  "response_body STRING, timestamp TIMESTAMP")
PREDICTIONS = ("email_id LONG, model STRING, p_spam DOUBLE, prediction STRING, scored_at TIMESTAMP")
AB_RESULTS = ("model STRING, prediction STRING, correct_label STRING, is_correct BOOLEAN, timestamp TIMESTAMP")
MODEL_REGISTRY = (
    "model_name STRING, version INT, algorithm STRING, dataset_version STRING, parameters MAP<STRING,STRING>, "
    "metrics STRUCT<accuracy: DOUBLE, precision: DOUBLE, recall: DOUBLE, f1_score: DOUBLE, "
    "confusion_matrix: ARRAY<ARRAY<LONG>>>, file_path STRING, status STRING, registered_at TIMESTAMP")
DATASET_VERSIONS = ("version STRING, filename STRING, source STRING, date_added TIMESTAMP, num_samples LONG, "
                        "columns ARRAY<STRING>, preprocessing_steps ARRAY<STRING>")
FEATURE_SETS = ("name STRING, path STRING, method STRING, dataset_version STRING, shape ARRAY<LONG>, "
                    "created_at TIMESTAMP")
EXPERIMENTS = ("timestamp TIMESTAMP, vectorizer STRING, best_model STRING, "
                   "results ARRAY<STRUCT<model: STRING, accuracy: DOUBLE, precision: DOUBLE, recall: DOUBLE, "
                   "f1_score: DOUBLE>>")
ALERTS = ("timestamp TIMESTAMP, level STRING, type STRING, reasons ARRAY<STRING>, email_preview STRING")
AUDIT = ("timestamp TIMESTAMP, event_type STRING, details STRING")
EVENTS = ("event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING")
DOCUMENTS = ("doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
