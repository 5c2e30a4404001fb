"""veilspark: Spark-native redaction, screening and admission for text corpora.

Every operator is a ``DataFrame -> DataFrame`` transform::

    from veilspark import redact, rehydrate_json, screen
    out = redact(docs, id_col="doc_id", text_col="text", context_col="context")
"""

from .operators.admission import token_bucket
from .operators.audit import audit, audit_json
from .operators.conversation import redact_conversations
from .operators.detect import detect, detect_spans
from .operators.normalize import normalize
from .operators.redact import redact
from .operators.rehydrate import rehydrate, rehydrate_json, vault_join
from .operators.sanitize import sanitize
from .operators.screen import screen

__all__ = [
    "audit", "audit_json", "detect", "detect_spans", "normalize", "redact", "redact_conversations", "rehydrate", "rehydrate_json",
    "sanitize", "screen", "token_bucket", "vault_join",
]
