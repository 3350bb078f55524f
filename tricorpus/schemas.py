"""Schemas of the data sets that stages exchange, as DDL."""

METADATA = "id string, categories string"
PAPER_TEXT = "paper string, text string"
SENTENCES = "paper string, pos int, sentence string"
CLAIMS = "paper string, pos int, sentence string, score double"
TRIPLETS = "paper string, pos int, subject string, verb string, object string"
TRIPLET_LISTS = "paper string, triplets array<struct<subject:string,verb:string,object:string>>"
TERM_DF = "term string, df long"
TERM_SCORES = "term string, score double"
EMBEDDINGS = "term string, embedding array<float>"
CLUSTERS = "term string, cluster string"
PAPER_CATEGORY = "paper string, category string"
PAIRS = "array<struct<abbr:string,definition:string>>"
SPANS = "array<struct<start:int,end:int>>"
