"""Streaming: applying fitted, stateless transforms to ``readStream`` input.

The reference has no streaming operators (no watermark, window or state);
nothing stateful is built here.  What carries over is that every fitted
transform (quantile caps, robust scaling, feature expressions, model
scoring) is a per-row expression, so a stream is scored with the same
code once the fitted statistics are frozen into literals.
"""

from riskframe.streaming.score import freeze_stats, apply_frozen, score_stream

__all__ = ["freeze_stats", "apply_frozen", "score_stream"]
