"""textlab: comparing how groups of authors and speakers use language, on Spark."""
