"""Graph, retrieval and quantization operators over DataFrames."""
