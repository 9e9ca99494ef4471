"""Column-level functions (all JVM-side built-in expressions)."""

from tmweave.functions.keys import decode_key, document_id, output_key  # noqa: F401
from tmweave.functions.text import (  # noqa: F401
    build_prompt, confidence_percent, context_size, embedding_request, js_number_string,
    model_request, parse_completion, parse_embedding, render_template, resolve_model,
)
from tmweave.functions.vectors import cosine_plus_one, hash_embedding, tokenize  # noqa: F401
