"""Training-data operators. Nothing outside this subpackage imports it."""

import os

# The matrices here are small: more than one BLAS thread only costs. It must be set before numpy is loaded.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
