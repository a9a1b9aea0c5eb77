"""Constants that change results, and the feature flags of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    embed_dim: int = 384
    n_views: int = 3
    resonance_threshold: float = 0.12
    spike_decay: float = 0.72
    spike_floor: float = 0.03
    enqueue_floor: float = 0.024
    prune_threshold: float = 0.08
    max_hops: int = 12
    max_chain_len: int = 16
    max_chains: int = 8
    fast_ring_cap: int = 2048
    fast_ring_boost: float = 1.15
    max_edge_nodes: int = 16
    working_memory_slots: int = 16
    episodic_cap: int = 10_000
    feedback_ring: int = 512
    context_history: int = 64
    ae_hidden: int = 192
    ae_prune: float = 0.72
    ae_fast: float = 0.18
    temporal_lambda: float = 0.0002
    vae_latent: int = 64
    vae_hidden: int = 256
    pacbayes_delta: float = 0.05
    spectral_k: int = 8
    calibration_buckets: int = 20
    pagerank_damping: float = 0.85
    pagerank_rounds: int = 20
    hebbian_rate: float = 0.04
    hebbian_floor: float = 0.05
    hebbian_ceiling: float = 0.97
    hebbian_decay: float = 0.9995
    attention_temperature: float = 0.8
    attention_fire: float = 0.15
    message_blend: float = 0.15
    selfgrow_threshold: float = 0.18
    seeds: int = 16
    # Periods of maintenance, in queries.
    prune_every: int = 25
    pagerank_every: int = 100
    ae_every: int = 200
    pacbayes_every: int = 200
    spectral_every: int = 500
    # Feature flags.
    use_multiview: bool = True
    use_messages: bool = True
    use_attention: bool = True
    use_autoencoder: bool = True
    use_temporal: bool = True
    use_vae: bool = False
    use_pacbayes: bool = True
    use_spectral: bool = True
    # Where the original's behaviour is order-bound, ``faithful`` keeps it; else the plain meaning holds.
    faithful: bool = True


DEFAULT = EngineConfig()
