"""weftline: distributed reductions, collectives, spatial, mesh, search and streaming operators on Spark."""
