"""Column expressions: URLs, text, numbers, JSON text."""

from civicspark.functions.text import (  # noqa: F401
    coerce_numeric, compose_process_number, error_timestamp, json_text,
    py_strip, sqlite_text, stringify_nested, strip_bom,
)
from civicspark.functions.urls import (  # noqa: F401
    base_of, month_url, normalize_url, path_after_marker, query_params,
    repair_retry_url, retry_eligible_te, retry_eligible_tp, strip_api_chars,
    template_params, template_url, topic_table_name, url_part,
)
