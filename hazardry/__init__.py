"""hazardry: curation and evaluation of perception datasets as Spark DataFrame plans."""
