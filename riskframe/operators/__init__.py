"""DataFrame -> DataFrame operators.

prefix     W2 bucketed running totals
quantiles  A3/A4 exact (and approximate) quantiles, IQR fences
stats      robust statistics, profiling, fitted caps/scalers, weights
rank       W1/W3/W4/W5 ranks, latest record, quantile bins, folds
metrics    A17-A23 classification and ranking metrics
ensemble   U1/J1/J2/E1-E7/F4 score tables and blends
blocks     bounded-block numpy distance kernels
resample   exact kNN, SMOTE, Tomek links
models     pyspark.ml fits, out-of-fold scores, search
cluster    PCA embedding, eps range join, DBSCAN, quality indices
"""
