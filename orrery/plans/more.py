"""Further inventory rows in SQL."""

from __future__ import annotations

from orrery.plans.registry import relational

relational("og4_reconcile", "SELECT e.vec_id FROM {embeddings} e LEFT ANTI JOIN {documents} d ON d.doc_id = e.vec_id AND d.lang = 'en'", "SELECT vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id AND d.lang = 'en')")
relational("og10_delete_documents", "SELECT d.doc_id, d.source FROM {documents} d LEFT ANTI JOIN (SELECT doc_id FROM {labels} WHERE toxic = 1) l ON l.doc_id = d.doc_id", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
