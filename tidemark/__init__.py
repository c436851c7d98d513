"""Version and changelog extraction over tables of web pages, as Spark DataFrame operators."""
