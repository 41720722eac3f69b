"""Operations for training-data pipelines over documents, vectors, pages and conversations.

One module per operator; ``registry`` lists their queries and check SQL. Nothing outside this
package imports it."""
