"""Declared schemas of the tables; nothing is inferred."""

BLOCK = "struct<text:string,bbox:array<double>,font_size:double,is_bold:boolean,font_name:string,block_type:string>"
PAGES = f"document_id string, filename string, version string, total_pages int, doc_quality double, page_number int, text string, quality_score double, blocks array<{BLOCK}>, tables array<array<array<string>>>"
NODES = "node_id string, document_id string, document_version string, page_start int, page_end int, section_number string, heading string, parent_id string, text string, normalized_text string, content_type string, depth int, `order` int, raw_text string, font_info struct<size:double,is_bold:boolean,name:string>, table_data array<array<string>>"
ALIGNMENTS = "comparison_id string, alignment_type string, old_node_id string, new_node_id string, confidence double, match_method string, similarity_scores map<string,double>"
DOCUMENTS = "document_id string, filename string, title string, circular_number string, issue_date string, update_date string, total_pages int, version string, quality_score double, file_path string, parsed_data string, created_at string"
COMPARISONS = "comparison_id string, old_document_id string, new_document_id string, status string, progress double, current_stage string, total_changes int, substantive_changes int, editorial_changes int, statistics string, llm_available boolean, error_message string, created_at string, completed_at string, logged_at string"
REFERENCE = "struct<document_id:string,page:int,page_end:int,section:string,clause:string,heading:string,text:string,node_id:string>"
CONFIDENCE = "struct<structural_match:double,lexical_similarity:double,semantic_similarity:double,numerical_agreement:double,evidence_quality:double,overall:double>"
OBLIGATION = "struct<old_terms:array<string>,new_terms:array<string>,old_strength:int,new_strength:int,direction:string,explanation:string>"
REVIEWS = "comparison_id string, change_id string, review_status string, reviewer_comment string, reviewed_at timestamp"
NUMBERS = "array<struct<field:string,old_value:string,new_value:string,old_numeric:double,new_numeric:double,unit:string,direction:string,magnitude_percent:double>>"
CHANGES = f"change_id string, old_node_id string, new_node_id string, change_type string, category string, is_substantive boolean, confidence {CONFIDENCE}, old_reference {REFERENCE}, new_reference {REFERENCE}, change_summary string, old_requirement string, new_requirement string, numerical_changes {NUMBERS}, obligation_change {OBLIGATION}, evidence array<string>, diff_highlights array<struct<old_html:string,new_html:string>>, negation_changed boolean, impact string, confidence_overall double, comparison_id string"
SUMMARY = "comparison_id string, category string, impact string, change_type string, is_substantive boolean, band string, n bigint, confidence_sum double, confidence_n bigint"
