"""Job parameters (thresholds, switches, wording) as one frozen value object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # mail intake
    max_results: int = 10
    poll_seconds: int = 60
    # gate and quality
    min_confidence: float = 0.5
    pass_score: float = 7.0
    max_revisions: int = 2
    # chunking
    chunk_size: int = 1000
    chunk_overlap: int = 200
    # characters of a text that are put into a prompt
    prompt_body_chars: int = 500
    prompt_reply_chars: int = 800
    prompt_context_chars: int = 300
    # retrieval
    top_k: int = 4
    alpha: float = 0.7
    rrf_k: int = 60
    keep_sentences: int = 4
    use_hybrid: bool = True
    use_rerank: bool = True
    use_compression: bool = True
    use_rewrite: bool = True
    use_variants: bool = False
    use_decomposition: bool = False
    retrieve_for_inquiry: bool = False
    # reply cache and account snapshots
    jaccard: float = 0.8
    ttl_hours: int = 168
    stored_body_chars: int = 500
    account_ttl_seconds: int = 300
    # wording owned by the user of the library
    product: str = "Acme Desk"
    team: str = "Acme Desk Team"
    support_address: str = "support@acme-desk.example"

    @property
    def advanced(self) -> bool:
        return self.use_variants or self.use_decomposition

    @property
    def signature(self) -> str:
        return f"Thanks,\n{self.team}\n{self.support_address}"


DEFAULTS = Settings()
