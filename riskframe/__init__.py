"""riskframe: robust statistics, feature construction, ranking metrics,
ensembling and density clustering expressed as Spark DataFrame jobs.

Layout
------
sources/    readers and writers (tables, results log, stage state, telemetry)
functions/  column-expression builders (features, clipping, cyclic time)
operators/  DataFrame -> DataFrame operators (quantiles, stats, ranks,
            metrics, ensembles, resampling, models, clustering)
plans/      end-to-end compositions (outlier profile, fraud scoring,
            customer segmentation)
streaming/  applying fitted, stateless transforms to streaming input
"""

from riskframe.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
