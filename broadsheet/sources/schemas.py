"""Table schemas of the article archive."""

ARTICLE = (
    "article_id string, publication string, publication_raw string, lccn string, state string, date string, year int, page_number int, edition string, headline string, byline string, "
    "text string, n_chars int, n_words int, legibility string, scan_url string, scan_id string, license string, processing_version string"
)
#: JSON of one page scan; the articles lie under the key "full articles".
SCAN = (
    "lccn struct<title:string,lccn:string,state:string>, edition struct<date:string,edition:string>, page_number string, scan_url string, bboxes array<struct<id:int,legibility:string>>, "
    "`full articles` array<struct<object_ids:array<int>,article:string,headline:string,byline:string,full_article_id:string>>"
)
LABEL = "entity_id string, n int, is_person string, gender_text string, roles array<string>, quoted string, confidence int, notes string"
