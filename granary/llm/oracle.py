"""SQL for those pN_ queries that SQL can express on whole tables."""

ORACLE: dict[str, str] = {
    # decoding undoes encoding, so SQL knows the result without knowing the tokenizer
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
}
