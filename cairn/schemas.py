"""Schemas of the tables that are read and kept."""

NEWS = "id long, title string, summary string, source_name string, source_type string, source_url string, importance int, ai_score int, tags string, category string, published_at string, reason string, date_verified boolean, research_topic string, is_research_report boolean"
SOURCE = "name string, type string, score int, update_freq string, last_update string, status string, reason string"
DAY = "total long, curated long, highlights long, avg_score double, categories map<string,long>, sources array<string>"
STORE = f"news array<struct<{NEWS.replace(' ', ':').replace(',:', ',')}>>, sources array<struct<{SOURCE.replace(' ', ':').replace(',:', ',')}>>, days map<string,struct<{DAY.replace(' ', ':').replace(',:', ',')}>>, source_health map<string,struct<count:long,ok:boolean>>, version string, last_updated string"
REPORT = "id string, institution string, institution_cn string, layer string, title string, publish_date string, topic string, key_data array<string>, key_insight string, url string, source_type string, auto boolean, curated boolean, fetched_at string"
REGISTRY = f"last_updated string, description string, layers map<string,string>, topics map<string,string>, reports array<struct<{REPORT.replace(' ', ':').replace(',:', ',')}>>"
INBOX = "url string, source_name string, source_type string, authority int, published_at string, reason string"
RAW_ITEM = "title string, url string, content string, source_name string, source_type string, published_at string, date_verified boolean, category_hint string, language string"
RSS = "title string, link string, description string, summary string, pubDate string, source string"
ATOM = "title string, link array<struct<_href:string>>, summary string, updated string"
SEARCH = "result struct<cmsArticleWebOld:array<struct<title:string,content:string,date:string,url:string,mediaName:string>>>"
QUALITY = "date string, total_items long, category_diversity long, source_diversity long, max_single_source_pct double, avg_score double, distinct_channels long, new_channel_items long, stock_noise_count long, source_distribution map<string,long>, category_distribution map<string,long>, pass boolean"
_ITEM = f"array<struct<{RSS.replace(' ', ':').replace(',:', ',')}>>"
#: A whole feed, of whichever kind.
FEED = f"channel struct<item:{_ITEM}>, item {_ITEM}, entry array<struct<{ATOM.replace(' ', ':').replace(',:', ',')}>>, _broken string"
